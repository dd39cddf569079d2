"""Inputs of the registered queries, derived from the tables alike in Spark and in SQL.

``manifest`` and ``results`` stand for queries with known answers and ranked
answers of systems; ``segments`` and ``clips`` for library vectors and queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .registry import table

MANIFEST = """SELECT o_orderkey AS query_id, o_orderkey % 97 AS ref_id, CASE WHEN o_custkey % 3 = 0 THEN 'carnatic' ELSE 'hindustani' END AS corpus,
 CAST(o_orderkey % 600 AS DOUBLE) / 2 AS offset_sec, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 10 END AS length_s,
 CASE WHEN o_orderkey % 8 < 5 THEN 'main' ELSE 'ablation' END AS split, o_custkey % 7 = 0 AS has_twin,
 CASE WHEN o_orderkey % 11 < 4 THEN 'alaap' WHEN o_orderkey % 11 < 9 THEN 'composed' END AS section_type FROM {orders}"""


def results_sql(system: int = 0) -> str:
    """Ranked answers of a system: lines that weren't returned; orders without such lines have none."""
    return f"""SELECT l_orderkey AS query_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity) AS INT) AS rank,
 CASE WHEN (l_partkey * 7 + {system} * 13 + l_suppkey) % 5 < {3 + system % 2} THEN l_orderkey % 97 ELSE l_suppkey % 97 END AS predicted_ref_id,
 (100 - l_quantity) / 100 AS score, CAST(l_quantity AS INT) AS match_count, CAST(l_orderkey % 600 AS DOUBLE) / 2 + CAST(l_partkey % 5 AS DOUBLE) * 3 / 10 AS ref_start,
 CAST(0 AS DOUBLE) AS query_start, l_quantity + l_tax AS latency_ms FROM {{lineitem}} WHERE l_returnflag <> 'R'"""


#: Lines of a task, about, where results are dealt by size.
LINES = 500_000


def line_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts of about ``LINES`` lines of orders; the count is read from the files' footers."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // LINES))


def manifest(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """``parts`` deals the queries by their id, as ``results`` does."""
    orders = table(spark, sf_dir, "orders")
    return spark.sql(MANIFEST, orders=orders.repartition(parts, "o_orderkey") if parts else orders)


def results(spark: SparkSession, sf_dir: str, system: int = 0, parts: int | None = None) -> DataFrame:
    """``parts`` deals lines by their query before they are ranked, so that ranks, joins by query and writes stay in place."""
    lines = table(spark, sf_dir, "lineitem")
    return spark.sql(results_sql(system), lineitem=lines.repartition(parts, "l_orderkey") if parts else lines)


def with_eval(*systems: int) -> str:
    """CTEs ``manifest``, ``r0``, ``r1`` ... of the SQL side."""
    parts = [f"manifest AS ({MANIFEST.replace('{orders}', 'orders')})"]
    parts += [f"r{s} AS ({results_sql(s).replace('{lineitem}', 'lineitem')})" for s in (systems or (0,))]
    return "WITH " + ", ".join(parts) + " "


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    ref = F.floor(F.col("vec_id") / 25)
    return e.select(F.col("vec_id").alias("global_idx"), ref.alias("ref_id"), (F.col("vec_id") % 25).alias("segment_idx"), ((F.col("vec_id") % 25) * 0.5).alias("segment_start_sec"), (ref % 10).alias("artist"), F.col("embedding").cast("array<double>").alias("embedding"))


def clips(spark: SparkSession, sf_dir: str, length: int, weight: float) -> DataFrame:
    """A query of ``length`` segments for each recording, with noise from another segment: ``query_id, q_off, embedding``."""
    seg = segments(spark, sf_dir)
    lib = seg.select("global_idx", "embedding")
    n = lib.count()
    rows = seg.where("segment_idx = 3").select(F.col("ref_id").alias("query_id"), "global_idx", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("q_off"))
    rows = rows.select("query_id", F.col("q_off").cast("long").alias("q_off"), (F.col("global_idx") + F.col("q_off")).alias("v")).withColumn("other", (F.col("v") * 7 + 3) % n)
    own = lib.select(F.col("global_idx").alias("v"), F.col("embedding").alias("a"))
    far = lib.select(F.col("global_idx").alias("other"), F.col("embedding").alias("b"))
    mixed = rows.join(own, "v").join(far, "other")
    return mixed.select("query_id", "q_off", V.normalise(V.axpy(F.col("a"), F.lit(weight), F.col("b"))).alias("embedding"))


def with_clips(length: int, weight: float) -> str:
    """CTEs ``seg``, ``clip`` of the SQL side."""
    return f"""WITH seg AS (SELECT vec_id g, vec_id // 25 ref_id, (vec_id // 25) % 10 artist, (vec_id % 25) * 0.5::DOUBLE start_sec, embedding::DOUBLE[] e FROM embeddings),
 raw AS (SELECT i query_id, j q_off, 25 * i + 3 + j v FROM (SELECT DISTINCT vec_id // 25 i FROM embeddings WHERE vec_id % 25 = 3) a, range({length}) b(j)),
 mix AS (SELECT query_id, q_off, list_transform(list_zip(x.e, y.e), lambda p: p[1] + {weight}::DOUBLE * p[2]) m FROM raw JOIN seg x ON x.g = v JOIN seg y ON y.g = (7 * v + 3) % (SELECT count(*) FROM embeddings)),
 clip AS (SELECT query_id, q_off, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) q FROM mix) """


def with_search(length: int, weight: float, probe: int = 20, k: int = 10) -> str:
    """CTEs up to ``probe``, ``cand``, ``scored`` and ``ranked`` (query_id, cand, score, rank)."""
    return with_clips(length, weight) + f""", ip AS (SELECT query_id, q_off, g, round(list_inner_product(q, e), 6) ip FROM clip, seg),
 probe AS (SELECT *, row_number() OVER (PARTITION BY query_id, q_off ORDER BY ip DESC, g) n FROM ip QUALIFY n <= {probe}),
 cand AS (SELECT DISTINCT query_id, g - q_off cand FROM probe WHERE g - q_off >= 0 AND g - q_off + {length} <= (SELECT count(*) FROM embeddings)),
 scored AS (SELECT query_id, cand, round(avg(list_inner_product(q, e)), 6) score FROM cand JOIN clip USING (query_id) JOIN seg ON g = cand + q_off GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand) rank FROM scored QUALIFY rank <= {k}) """
