"""Queries of scans, projections, filters, joins, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources
from ..functions.strings import match_line
from ..functions.time import micros
from ..operators.numbering import numbered
from ..operators.quantiles import quantiles
from ..sources.folders import new_folder
from .fixtures import manifest, results, with_eval, with_search
from .registry import register, sql_on, table


def same(ids: str, text: str, *names: str, duck: str | None = None):
    """Register one SQL text for both engines; tables are written ``{name}``."""
    oracle = duck or text
    for n in names:
        oracle = oracle.replace("{" + n + "}", n)
    register(ids, oracle)(lambda spark, d: sql_on(spark, d, text, *names))


same("PRJ-1 PRJ-2", "SELECT c_custkey AS ref_id, c_name AS label, c_acctbal * 2 AS doubled FROM {customer}", "customer")
same("PRJ-5 SRC-22", "SELECT r_regionkey AS id, r_name AS name, 'region' AS corpus FROM {region} UNION ALL SELECT n_nationkey, n_name, 'nation' FROM {nation}", "region", "nation")
@register("PRJ-6 WIN-5", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT quantity, (row_number() OVER o - 1)::BIGINT global_idx, (sum(l_quantity::BIGINT) OVER o - l_quantity::BIGINT)::BIGINT base FROM lineitem WINDOW o AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING)")
def positions(spark, d):
    """The number of each row, and the sum of all quantities before it: first positions of recordings in one index."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))
    return numbered(rows, ["l_orderkey", "l_linenumber", "l_partkey", "quantity"], new_folder(spark), "global_idx", base="quantity")


@register("PRJ-7", "SELECT user_id, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS id FROM (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id)")
def dense_ids(spark, d):
    """Numbers of users in the order of their first event."""
    first = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first"))
    return numbered(first, ["first", "user_id"], new_folder(spark), "id").select("user_id", "id")


same("FLT-3 FLT-5 FLT-7", "SELECT o_orderkey FROM {orders} WHERE o_orderpriority IS NOT NULL AND o_totalprice >= 90000 AND NOT (o_orderstatus = 'O')", "orders")
same("FLT-12", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%red%' OR p_name LIKE '%lime%'", "part")
same("FLT-14", "SELECT ref_id, length_s, query_id FROM (SELECT o_custkey % 50 AS ref_id, o_orderkey % 4 AS length_s, o_orderkey AS query_id, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 4 ORDER BY md5(CAST(o_orderkey AS STRING)), o_orderkey) AS n FROM {orders}) WHERE n = 1", "orders",
     duck="SELECT ref_id, length_s, query_id FROM (SELECT o_custkey % 50 AS ref_id, o_orderkey % 4 AS length_s, o_orderkey AS query_id, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 4 ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS n FROM orders) WHERE n = 1")
same("FLT-15", "SELECT l.doc_id, coalesce(b.quality, -1) AS quality, coalesce(b.toxic, 0) AS toxic FROM {documents} l LEFT JOIN {labels} b ON l.doc_id = b.doc_id WHERE l.lang IS NOT NULL", "documents", "labels")
same("FLT-16", "SELECT event_id, CAST(value AS INT) AS whole, CAST(user_id AS STRING) AS name, try_cast(event_type AS INT) IS NULL AS rejected FROM {events}", "events",
     duck="SELECT event_id, trunc(value)::INT AS whole, user_id::VARCHAR AS name, try_cast(event_type AS INT) IS NULL AS rejected FROM events")
same("FLT-17 TOPK-5 LIM-1", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 1200 ORDER BY o_totalprice, o_orderkey LIMIT 2", "orders")
same("TOPK-6 SRC-13", "SELECT event_id, ts FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 10", "events")
same("SRC-14", "SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_done FROM {orders}", "orders")
same("JOIN-3", "SELECT s.o_orderkey, c.c_name FROM {orders} s JOIN {customer} c ON s.o_custkey = c.c_custkey", "orders", "customer")
same("JOIN-4 MTH-12", "SELECT s.s_suppkey, round(count(l.l_orderkey) / 60.0, 6) AS per_minute FROM {supplier} s LEFT JOIN {lineitem} l ON s.s_suppkey = l.l_suppkey GROUP BY s.s_suppkey", "supplier", "lineitem",
     duck="SELECT s.s_suppkey, round(count(l.l_orderkey) / 60.0, 6)::DOUBLE AS per_minute FROM supplier s LEFT JOIN lineitem l ON s.s_suppkey = l.l_suppkey GROUP BY s.s_suppkey")
same("JOIN-7 JOIN-8", "SELECT d.doc_id, coalesce(CAST(b.quality AS STRING), '') AS quality FROM {documents} d LEFT JOIN {labels} b ON d.doc_id = b.doc_id", "documents", "labels")
same("SET-1", "SELECT doc_id AS id, 'document' AS kind FROM {documents} UNION ALL SELECT item_id, 'item' FROM {benchmark}", "documents", "benchmark")
same("SORT-1 SORT-3 SORT-2", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM {events}", "events")
same("WIN-3", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM {events}", "events")
@register("LIM-2", "SELECT vec_id, score FROM (SELECT vec_id, label AS score, row_number() OVER (ORDER BY label, vec_id) AS n, count(*) OVER () AS total FROM embeddings) WHERE n = 11 OR n = CAST(floor(total / 2) AS INT) + 1 OR n = total - 4")
def picked_places(spark, d):
    """Rows at a low, a middle and a high place of the sorted table."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("score"))
    total = e.count()
    return numbered(e, ["score", "vec_id"], new_folder(spark)).where(F.col("n").isin(10, total // 2, total - 5)).select("vec_id", "score")


same("AGG-12", "SELECT section_type, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS section_type FROM {orders}) GROUP BY section_type", "orders")
same("AGG-13", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM {lineitem} GROUP BY l_returnflag", "lineitem")
same("AGG-14 UDF-4", "SELECT user_id, count(*) AS size, round(sum(coalesce(value, 0)) / 3600, 6) AS hours FROM {events} GROUP BY user_id", "events")
same("AGG-15", "SELECT lang, source, count(*) AS n FROM {documents} GROUP BY lang, source ORDER BY n DESC", "documents")
same("AGG-31", "SELECT event_type, sum(CASE WHEN coalesce(value > 50, false) THEN 1 ELSE 0 END) AS passed, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type", "events",
     duck="SELECT event_type, sum(CASE WHEN coalesce(value > 50, false) THEN 1 ELSE 0 END)::BIGINT AS passed, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
same("AGG-34", "SELECT sum(length(html)) AS total, count(*) AS n FROM {pages}", "pages", duck="SELECT sum(length(html))::BIGINT AS total, count(*) AS n FROM pages")
same("AGG-36", "SELECT p_name AS key, count(*) AS n FROM {part} GROUP BY p_name ORDER BY n DESC, key LIMIT 8", "part")
same("AGG-38", "SELECT count(*) AS collisions FROM (SELECT substr(md5(text), 1, 3) AS id FROM {documents} GROUP BY 1 HAVING count(DISTINCT text) > 1)", "documents")
same("MTH-13", "SELECT doc_id, md5(text) AS md5, sha2(text, 256) AS sha256 FROM {documents}", "documents", duck="SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
same("JSN-1 JSN-5 JSN-7", "SELECT event_id, coalesce(get_json_object(props, '$.kk'), get_json_object(props, '$.k'), 'none') AS k FROM {events}", "events", duck="SELECT event_id, coalesce(props->>'$.kk', props->>'$.k', 'none') AS k FROM events")


@register("AGG-32", "SELECT event_type, count(CASE WHEN user_id % 3 = 0 THEN 1 END) AS \"0\", count(CASE WHEN user_id % 3 = 1 THEN 1 END) AS \"1\", count(CASE WHEN user_id % 3 = 2 THEN 1 END) AS \"2\" FROM events GROUP BY 1")
def pivoted(spark, d):
    return table(spark, d, "events").withColumn("third", (F.col("user_id") % 3).cast("string")).groupBy("event_type").pivot("third", ["0", "1", "2"]).count().na.fill(0)


@register("PRJ-3 PRJ-4", "SELECT c_custkey, c_mktsegment FROM customer")
def optional_columns(spark, d):
    c = table(spark, d, "customer")
    wanted = [x for x in ("c_custkey", "c_mktsegment", "raagas") if x in c.columns]
    return c.select(*wanted).drop("audio_path", "taalas")


@register("FLT-8", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice < 20000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END], lambda x: x IS NOT NULL), ',') reasons FROM orders WHERE o_totalprice < 20000 OR o_orderstatus = 'P'")
def quarantine(spark, d):
    _, bad = sources.split_valid(table(spark, d, "orders"), cheap=F.col("o_totalprice") < 20000, pending=F.col("o_orderstatus") == "P")
    return bad.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@register("FLT-11 AUD-4", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN md5(html) ELSE substr(md5(html), 1, 32) END AS md5, page_id % 4 = 0 AS filled FROM pages")
def fill_hashes(spark, d):
    p = table(spark, d, "pages").withColumn("old", F.when(F.col("page_id") % 4 != 0, F.md5("html")))
    missing = F.coalesce(F.length("old") < 32, F.lit(True))
    return p.select("page_id", F.when(missing, F.md5("html")).otherwise(F.col("old")).alias("md5"), missing.alias("filled"))


@register("FLT-13", "SELECT event_id, value FROM events WHERE value < (SELECT quantile_cont(value, 0.05) FROM events)")
def low_outliers(spark, d):
    e = table(spark, d, "events")
    (cut,) = quantiles(e, "value", 0.05)
    return e.where(F.col("value") < F.lit(cut).cast("double")).select("event_id", "value")


@register("JOIN-18 SRC-18", """WITH k AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Supplier#' || user_id ELSE 'supplier/' || user_id END raw FROM events),
 s AS (SELECT 'Supplier#' || s_suppkey a, 'supplier_' || s_suppkey b, s_suppkey FROM supplier)
 SELECT event_id, coalesce(x.s_suppkey, y.s_suppkey) resolved FROM k LEFT JOIN s x ON raw = x.a LEFT JOIN s y ON replace(raw, '/', '_') = y.b""")  # fmt: skip
def fallback_join(spark, d):
    k = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Supplier#"), "user_id")).otherwise(F.concat(F.lit("supplier/"), "user_id")).alias("raw"))
    s = table(spark, d, "supplier")
    x = s.select(F.concat(F.lit("Supplier#"), "s_suppkey").alias("raw"), F.col("s_suppkey").alias("x"))
    y = s.select(F.concat(F.lit("supplier_"), "s_suppkey").alias("plain"), F.col("s_suppkey").alias("y"))
    return k.join(x, "raw", "left").withColumn("plain", F.replace("raw", F.lit("/"), F.lit("_"))).join(y, "plain", "left").select("event_id", F.coalesce("x", "y").alias("resolved"))


_LOG = "concat_ws(' ; ', cast(event_id % 7 AS {s}), '7', 'q' || user_id || '.wav', '0', '3', 'r.mp3', cast(user_id AS {s}), cast(event_id % 100 AS {s}), cast(event_id % 100 + 3 AS {s}), CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE cast(event_id % 40 AS {s}) END, '1.00 %', '0.99 %', '87.5 %')"


@register("STR-8", "SELECT event_id, user_id match_id, (event_id % 100)::DOUBLE ref_start, (event_id % 100 + 3)::DOUBLE ref_stop, (event_id % 40)::INT match_count, 87.5::DOUBLE matched_pct FROM events WHERE event_id % 13 <> 0")
def parsed_lines(spark, d):
    lines = sql_on(spark, d, f"SELECT event_id, {_LOG.format(s='STRING')} AS line FROM {{events}}", "events")
    f = match_line(F.col("line"))
    out = lines.select("event_id", f["match_id"].alias("match_id"), f["ref_start"].alias("ref_start"), f["ref_stop"].alias("ref_stop"), f["match_count"].alias("match_count"), f["seconds_with_match_pct"].alias("matched_pct"))
    return out.dropna()


#: A tool's output: a banner, lines with a field that is no number, lines with more fields than needed, and good ones.
_OUTPUT = """CASE WHEN event_id % 17 = 0 THEN 'Query processed in ' || event_id || ' ms' WHEN event_id % 11 = 0 THEN replace(line, 'q', 'x;q') ELSE line || CASE WHEN event_id % 5 = 0 THEN ' ; more' ELSE '' END END"""


@register("SRC-15 RET-7", """WITH good AS (SELECT event_id, user_id, event_id % 40 score FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 11 <> 0),
 ranked AS (SELECT user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) rank FROM good),
 q AS (SELECT c_custkey user_id FROM customer)
 SELECT q.user_id query_id, coalesce(rank, 0)::INT rank, score::INT match_count FROM q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r USING (user_id)""")  # fmt: skip
def ingested_matches(spark, d):
    """Lines of text files, parsed, ranked by their order for each query, and every query kept (rank 0: no match)."""
    to = new_folder(spark)
    lines = sql_on(spark, d, f"SELECT event_id, {_OUTPUT} AS line FROM (SELECT event_id, user_id, {_LOG.format(s='STRING')} AS line FROM {{events}})", "events")
    # a tool's lines come in order; here each names its place, as files of several tasks have none
    lines.select(F.concat_ws("\t", F.col("event_id").cast("string"), "line").alias("value")).write.text(to)
    read = sources.read_lines(spark, to).select(F.substring_index("value", "\t", 1).cast("long").alias("place"), F.expr("substr(value, instr(value, '\t') + 1)").alias("line"))
    f = match_line(F.col("line"))
    found = read.select("place", F.regexp_extract(f["query_path"], "q([0-9]+)", 1).try_cast("bigint").alias("query_id"), f["match_count"].alias("match_count")).dropna()
    order = Window.partitionBy("query_id").orderBy("place")
    top = found.withColumn("rank", F.row_number().over(order)).where("rank <= 5").drop("place")
    queries = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("query_id"))
    return queries.join(top, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(0)).alias("rank"), "match_count")


@register("STR-9", "SELECT event_id, (event_id % 50)::INT n_prints, floor(value * 10)::INT ms FROM events")
def log_numbers(spark, d):
    line = F.format_string("Query for %d prints, 3 matches in %d ms", F.col("event_id") % 50, F.floor(F.col("value") * 10).cast("int"))
    e = table(spark, d, "events").withColumn("line", line)
    return e.select("event_id", F.regexp_extract("line", r"Query for (\d+) prints", 1).cast("int").alias("n_prints"), F.regexp_extract("line", r"in (-?\d+) ms", 1).cast("int").alias("ms"))


@register("WIN-2", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events")
def emission_rank(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))


@register("WIN-4", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) carried FROM events")
def carried(spark, d):
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.last_value(F.when(F.col("event_type") == "click", F.col("value")), F.lit(True)).over(order).alias("carried"))


@register("WIN-8.events", """WITH c AS (SELECT user_id % 16 f, epoch_us(ts) // 3600000000 t, max(value) v FROM events GROUP BY 1, 2)
 SELECT a.f, a.t, a.v FROM c a WHERE a.v >= (SELECT max(v) FROM c b WHERE b.f BETWEEN a.f - 3 AND a.f + 3 AND b.t BETWEEN a.t - 15 AND a.t + 15)""")  # fmt: skip
def peaks(spark, d):
    c = table(spark, d, "events").groupBy((F.col("user_id") % 16).alias("f"), F.floor(micros(F.col("ts")) / 3_600_000_000).alias("t")).agg(F.max("value").alias("v"))
    near = c.select(F.explode(F.sequence(F.col("f") - 3, F.col("f") + 3)).alias("f"), "t", "v").groupBy("f", "t").agg(F.max("v").alias("m"))
    top = near.withColumn("m", F.max("m").over(Window.partitionBy("f").orderBy("t").rangeBetween(-15, 15)))
    return c.join(top, ["f", "t"]).where("v >= m").select("f", "t", "v")


@register("SET-2", "SELECT a.p_partkey, len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) common FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def intersections(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", F.size(F.array_intersect("a", "b")).cast("long").alias("common"))


@register("AGG-39", "SELECT count(*) n, round(sum(value), 4) total, max(value) most, count_if(value < 1) failed FROM events")
def accumulators(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"), F.count_if(F.col("value") < 1).alias("failed"))


@register("SRC-1 SRC-2 SNK-3 SNK-5", "SELECT n_nationkey::VARCHAR ref_id, n_name corpus FROM nation")
def csv_round_trip(spark, d):
    """A CSV file for each region and all of them read as one table."""
    n, to = table(spark, d, "nation"), new_folder(spark)
    rows = n.select(F.col("n_nationkey").cast("string").alias("ref_id"), F.col("n_name").alias("corpus"), "n_regionkey")
    regions = [r[0] for r in n.select("n_regionkey").distinct().collect()]
    for r in regions:
        sources.write_csv(rows.where(F.col("n_regionkey").eqNullSafe(F.lit(r))).drop("n_regionkey"), f"{to}/{r}")
    schema = sources.REFS.__class__([sources.REFS["ref_id"], sources.REFS["corpus"]])
    return sources.read_csv(spark, [f"{to}/{r}" for r in regions], schema)


@register("SNK-1", with_eval() + "SELECT query_id, rank FROM r0 JOIN manifest USING (query_id) WHERE split = 'main' AND length_s = 3")
def partitioned(spark, d):
    to = new_folder(spark)
    rows = results(spark, d).join(manifest(spark, d).select("query_id", "split", "length_s"), "query_id").withColumn("system", F.lit("base"))
    sources.write_results(rows, to)
    return sources.read_results(spark, to, system="base", split="main", length_s=3).select("query_id", "rank")


@register("SNK-6", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def variant_sink(spark, d):
    to = new_folder(spark)
    sources.write_results(table(spark, d, "embeddings").select("vec_id", "label"), to, "label")
    return sources.read_results(spark, to, label=3)


@register("SNK-8 SNK-10", "SELECT c_custkey, c_acctbal, c_acctbal > 0 positive FROM customer")
def staged_export(spark, d):
    to = new_folder(spark)
    table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name").drop("c_name").orderBy("c_custkey").write.parquet(to)
    return spark.read.parquet(to).withColumn("positive", F.col("c_acctbal") > 0)


@register("SNK-9")
def checksums(spark, d):
    """All files of the folder."""
    return sources.artefacts(spark, d)


@register("SRC-16")
def file_listing(spark, d):
    return sources.listing(spark, d).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


@register("SRC-20 JSN-8", "SELECT event_id, event_type kind, user_id AS \"user\" FROM events")
def flattened(spark, d):
    nested = table(spark, d, "events").select("event_id", F.struct(F.struct("event_type", "user_id", "value").alias("b")).alias("a"))
    slim = nested.withColumn("a", F.col("a").withField("b", F.col("a.b").dropFields("value")))
    return slim.select("event_id", F.col("a.b.event_type").alias("kind"), F.col("a.b.user_id").cast("long").alias("user"))


@register("SRC-12.events", "SELECT event_id, i start, i + 2 stop, 'label' || i AS label FROM events, range(3) t(i)")
def annotations(spark, d):
    """Each event's annotation as JSON text and parsed again."""
    number = lambda i: F.lit(i).cast("long")
    e = table(spark, d, "events").select(
        F.to_json(
            F.struct(
                F.col("event_id").cast("long").alias("event_id"),
                F.array(*[F.array(number(i), number(i + 2)) for i in range(3)]).alias("intervals"),
                F.array(*[F.lit(f"label{i}") for i in range(3)]).alias("labels"),
            )
        ).alias("text")
    )
    e = e.select(F.from_json("text", "event_id bigint, intervals array<array<bigint>>, labels array<string>").alias("doc"))
    e = e.select("doc.event_id", F.inline(F.arrays_zip(F.col("doc.intervals").alias("interval"), F.col("doc.labels").alias("label"))))
    return e.select("event_id", F.get("interval", F.lit(0)).alias("start"), F.get("interval", F.lit(1)).alias("stop"), "label")


@register("JSN-2.struct", "SELECT conv_id, string_agg(coalesce(CASE WHEN turn % 3 = 0 THEN role END, 'turn' || turn), '; ' ORDER BY turn) \"names\" FROM conversations GROUP BY 1")
def joined_names(spark, d):
    one = F.struct("turn", F.struct(F.when(F.col("turn") % 3 == 0, F.col("role")).alias("name"), F.concat(F.lit("turn"), "turn").alias("title")).alias("a"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: F.coalesce(x["a"]["name"], x["a"]["title"])), "; ").alias("names"))


@register("STM-6", """SELECT epoch_us(w) // 1000000 AS start, event_type, count(*) n, round(sum(value), 6) total FROM
 (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) w FROM events) GROUP BY 1, 2""")  # fmt: skip
def sliding_windows(spark, d):
    from ..streaming import sliding_counts

    return sliding_counts(table(spark, d, "events")).select(F.floor(micros(F.col("w.start")) / 1_000_000).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@register("STM-2 STM-7", with_search(3, 0.8, k=5) + "SELECT query_id, cand, score, rank FROM ranked")
def streamed_identification(spark, d):
    """Clips as a stream of files, answered batch by batch; the same rows as RET-3."""
    from .. import streaming
    from .fixtures import clips, segments

    to = new_folder(spark)
    clips(spark, d, 3, 0.8).repartition(2, "query_id").write.parquet(f"{to}/in")
    q = spark.read.parquet(f"{to}/in")
    stream = streaming.read_parquet_stream(spark, f"{to}/in", q.schema)
    streaming.identify(stream, segments(spark, d), lambda found, n: found.write.mode("overwrite").parquet(f"{to}/out/batch={n}"), f"{to}/checkpoint")
    return spark.read.parquet(f"{to}/out").drop("batch")
