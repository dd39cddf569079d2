"""Queries of encoders, sound, reports and the remaining semantic rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.time import micros
from ..operators import calibrate as C
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators.encode import encode
from ..sources import media
from .fixtures import clips, manifest, results, segments, with_clips, with_eval
from .registry import register, table


def _samples(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples"))


@register("VEC-13.windows", "SELECT vec_id clip_id, count(*) n, 1.0::DOUBLE norm FROM embeddings, range(7) GROUP BY 1")
def encoded(spark, d):
    return encode(_samples(spark, d)).groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.max(V.norm(F.col("embedding"))), 6).alias("norm"))


@register("SNK-12", "SELECT 'clip' || vec_id AS path, 8000 samplerate, 64 n, true close FROM embeddings")
def wav_round_trip(spark, d):
    """Written as WAV, decoded again, within one step of 16 bits."""
    own = _samples(spark, d).select(F.concat(F.lit("clip"), "clip_id").alias("path"), "samples")
    back = media.decode_wav(media.encode_wav(own, 8000)).select("path", "samplerate", F.col("samples").alias("back"))
    far = F.array_max(F.zip_with("samples", "back", lambda a, b: F.abs(a.cast("double") - b)))
    return own.join(back, "path").select("path", "samplerate", F.size("back").alias("n"), (far < 1e-4).alias("close"))


@register("VEC-15.events", """WITH p AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 t, event_id % 512 f FROM events),
 o AS (SELECT *, lead(t, 1) OVER w t2, lead(f, 1) OVER w f2, lead(t, 2) OVER w t3, lead(f, 2) OVER w f3 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
 SELECT event_id, f2 - f d1, f3 - f2 d2, floor(16 * (t2 - t) / greatest(t3 - t, 1))::BIGINT ratio FROM o WHERE t3 IS NOT NULL""")  # fmt: skip
def triplets(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = table(spark, d, "events").select("user_id", "event_id", F.floor(micros(F.col("ts")) / 1_000_000).alias("t"), (F.col("event_id") % 512).alias("f"))
    for i in (1, 2):
        p = p.withColumn(f"t{i}", F.lead("t", i).over(w)).withColumn(f"f{i}", F.lead("f", i).over(w))
    ratio = F.floor(16 * (F.col("t1") - F.col("t")) / F.greatest(F.col("t2") - F.col("t"), F.lit(1)))
    return p.where("t2 is not null").select("event_id", (F.col("f1") - F.col("f")).alias("d1"), (F.col("f2") - F.col("f1")).alias("d2"), ratio.alias("ratio"))


@register("EVAL-9.lines", with_eval() + ", h AS (SELECT split, length_s, count(*) n, count_if(coalesce(r.predicted_ref_id = ref_id, false)) hits FROM manifest LEFT JOIN (SELECT * FROM r0 WHERE rank = 1) r USING (query_id) GROUP BY 1, 2) SELECT '| ' || split || ' | ' || length_s || ' s | ' || hits || '/' || n || ' |' line FROM h")
def report(spark, d):
    """Lines of a Markdown table, one for each cell."""
    cells = M.per_query(results(spark, d), manifest(spark, d)).groupBy("split", "length_s").agg(F.count("*").alias("n"), F.count_if(M.hit(1)).alias("hits"))
    return cells.select(F.format_string("| %s | %d s | %d/%d |", "split", "length_s", "hits", "n").alias("line"))


@register("QRK-2", with_eval() + ", neg AS (SELECT score FROM r0 WHERE rank >= 3) SELECT round(min(score) + 1e-6, 8) threshold FROM (SELECT score, row_number() OVER (ORDER BY score DESC) n FROM neg) WHERE n <= floor(0.05 * (SELECT count(*) FROM neg)) + 1")
def exact_threshold(spark, d):
    return C.threshold(results(spark, d).where("rank >= 3").select("score"), exact=True).select(F.round("threshold", 8).alias("threshold"))


@register("QRK-10", "SELECT n_nationkey, CASE WHEN n_nationkey < 2 THEN 0 ELSE (n_nationkey - 2) // 2 + 1 END n FROM nation")
def guarded_windows(spark, d):
    samples = F.when(F.col("n_nationkey") > 0, F.array_repeat(F.lit(1.0), F.col("n_nationkey"))).otherwise(F.array().cast("array<double>"))
    return table(spark, d, "nation").select("n_nationkey", F.size(V.windows(samples, 2, 2)).alias("n"))


@register("QRK-11 QRK-15 QRK-22", with_clips(2, 0.8) + ", s AS (SELECT * FROM seg WHERE g < 7), ip AS (SELECT query_id, q_off, g, round(list_inner_product(q, e), 6) ip FROM clip, s) SELECT query_id, q_off, g global_idx, ip, row_number() OVER (PARTITION BY query_id, q_off ORDER BY ip DESC, g) rank FROM ip")
def small_library(spark, d):
    return R.knn(clips(spark, d, 2, 0.8), segments(spark, d).where("global_idx < 7"), 20)


@register("QRK-17", with_eval() + "SELECT quantile_cont(CASE WHEN ref_start IS NULL THEN ref_start END, 0.5)::DOUBLE median, count(CASE WHEN ref_start IS NULL THEN ref_start END) n_aligned FROM manifest LEFT JOIN r0 USING (query_id)")
def no_alignment(spark, d):
    return M.alignment(results(spark, d).withColumn("ref_start", F.lit(None).cast("double")), manifest(spark, d)).select("median", "n_aligned")


@register("QRK-8", with_eval() + "SELECT count(*) n, count(DISTINCT (query_id, predicted_ref_id)) n_refs FROM r0")
def repeated_refs(spark, d):
    return results(spark, d).agg(F.count("*").alias("n"), F.countDistinct("query_id", "predicted_ref_id").alias("n_refs"))


@register("UDF-6.rows", with_eval(0, 1) + "SELECT system, count(*) n, count(DISTINCT query_id) n_queries FROM (SELECT 'base' system, query_id FROM r0 UNION ALL SELECT 'other', query_id FROM r1) GROUP BY 1")
def any_matcher(spark, d):
    rows = [results(spark, d, i).withColumn("system", F.lit(s)) for i, s in enumerate(("base", "other"))]
    return rows[0].unionByName(rows[1], allowMissingColumns=True).groupBy("system").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_queries"))
