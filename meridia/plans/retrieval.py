"""Queries of search and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.stats import rounded
from ..functions.time import micros
from ..operators import calibrate, rerank, retrieval as R
from ..operators.sampling import uniform_sample
from ..sources.folders import new_folder
from .fixtures import clips, segments, with_clips, with_search
from .registry import register, table


def _scores(spark, d, length=3, weight=0.8, probe=20):
    q, lib = clips(spark, d, length, weight), segments(spark, d)
    lengths = q.groupBy("query_id").agg(F.count("*").alias("length"))
    cands = R.candidates(R.knn(q, lib, probe), lengths, lib.count())
    return q, lib, cands


@register("FLAGSHIP", with_search(1, 0.8) + """, h AS (SELECT query_id, min(CASE WHEN cand // 25 = query_id THEN rank END) r FROM ranked GROUP BY 1)
 SELECT count(*) n, count_if(r = 1) hits_1, count_if(r <= 10) hits_10, round(sum(coalesce(1.0 / r, 0)) / count(*), 6)::DOUBLE mrr FROM h""")  # fmt: skip
def flagship(spark, d):
    found = R.sequence_search(clips(spark, d, 1, 0.8), segments(spark, d))
    first = found.groupBy("query_id").agg(F.min(F.when(F.floor(F.col("cand") / 25) == F.col("query_id"), F.col("rank"))).alias("r"))
    return first.agg(F.count("*").alias("n"), F.count_if(F.col("r") == 1).alias("hits_1"), F.count_if(F.col("r") <= 10).alias("hits_10"), F.round(F.sum(F.coalesce(1 / F.col("r"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"))


@register("JOIN-10 TOPK-2", with_search(3, 0.8) + "SELECT query_id, q_off, g global_idx, ip, n rank FROM probe")
def knn_join(spark, d):
    return R.knn(clips(spark, d, 3, 0.8), segments(spark, d), 20)


@register("VEC-7 SET-6 FLT-6", with_search(5, 0.8) + "SELECT query_id, cand FROM cand")
def candidate_starts(spark, d):
    return _scores(spark, d, 5)[2]


@register("SRC-6 JOIN-11 VEC-3", with_search(3, 0.8) + "SELECT query_id, cand, score FROM scored")
def diagonal(spark, d):
    q, lib, cands = _scores(spark, d)
    return R.rescore(cands, q, lib)


@register("RET-3 TOPK-1 WIN-1", with_search(9, 1.0) + "SELECT query_id, cand, score, rank FROM ranked")
def sequence(spark, d):
    return R.sequence_search(clips(spark, d, 9, 1.0), segments(spark, d))


def _of_length(length):
    @register(f"RET-3.L{length}", with_search(length, 1.0) + "SELECT query_id, cand, score, rank FROM ranked")
    def run(spark, d):
        return R.sequence_search(clips(spark, d, length, 1.0), segments(spark, d))


for _length in (1, 5, 19):
    _of_length(_length)


@register("QRK-7", with_search(5, 1.0) + """, fit AS (SELECT * FROM scored WHERE cand // 25 = (cand + 4) // 25)
 SELECT query_id, cand, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand) rank FROM fit QUALIFY rank <= 10""")  # fmt: skip
def within_recording(spark, d):
    return R.sequence_search(clips(spark, d, 5, 1.0), segments(spark, d), within_ref=True)


@register("RET-4 JOIN-6 MTH-10", with_search(3, 0.8) + """SELECT q.query_id, coalesce(rank, 0) rank, ref_id predicted_ref_id, cand predicted_segment_id, score, start_sec ref_start, start_sec + 2.0::DOUBLE ref_stop,
 CASE WHEN cand IS NOT NULL THEN 0::DOUBLE END query_start, CASE WHEN cand IS NOT NULL THEN 2::DOUBLE END query_stop
 FROM (SELECT unnest(range((SELECT max(vec_id) // 25 + 4 FROM embeddings))) query_id) q LEFT JOIN (SELECT * FROM ranked JOIN seg ON g = cand) USING (query_id)""")  # fmt: skip
def emitted(spark, d):
    last = segments(spark, d).agg(F.max("ref_id")).first()[0]
    manifest = spark.range(last + 4).select(F.col("id").alias("query_id"), F.lit(3).alias("n_segments"))
    return R.emit(R.sequence_search(clips(spark, d, 3, 0.8), segments(spark, d)), manifest, segments(spark, d))


@register("VEC-1 VEC-2", "SELECT a.vec_id, round(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 5) AS norm, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS ip FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def products(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(nxt, "vec_id").select("vec_id", rounded(V.norm(F.col("embedding")), 5).alias("norm"), rounded(V.dot(F.col("embedding"), F.col("next")), 6).alias("ip"))


@register("VEC-8 VEC-9 VEC-11 VEC-12", """SELECT vec_id, len(embedding[1:10]) head, list_sum(list_transform(embedding[1:10], lambda x: round((x * 2)::DOUBLE, 6))) scaled, 150 tiled, true finite FROM embeddings""")
def shaping(spark, d):
    e = F.col("embedding")
    total = F.aggregate(F.transform(F.slice(e, 1, 10), lambda x: rounded((x * 2).cast("double"), 6)), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.size(F.slice(e, 1, 10)).alias("head"), total.alias("scaled"), F.size(V.tile(e, F.lit(150))).alias("tiled"), V.finite(e).alias("finite"))


@register("VEC-10 MTH-5", """SELECT vec_id, list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda p: trunc(greatest(least((p[1]::DOUBLE + p[2]::DOUBLE) / 2 * 32767, 32767), -32768))::INT) pcm FROM embeddings""")
def downmix(spark, d):
    mono = F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    return table(spark, d, "embeddings").select("vec_id", F.transform(mono, lambda x: F.greatest(F.least(x * 32767, F.lit(32767.0)), F.lit(-32768.0)).cast("int")).alias("pcm"))


@register("WIN-6 STM-5", "SELECT vec_id, i \"at\", len(embedding[i*8+1:i*8+16]) width, embedding[i*8+1]::DOUBLE AS first FROM embeddings, range(7) t(i)")
def sliding(spark, d):
    w = table(spark, d, "embeddings").select("vec_id", F.explode(V.windows(F.col("embedding"), 16, 8)).alias("w"))
    return w.select("vec_id", F.col("w.at").alias("at"), F.size("w.window").alias("width"), F.get("w.window", F.lit(0)).cast("double").alias("first"))


@register("AGG-20 VEC-5", "SELECT label, count(*) n, round(sum(embedding[1]::DOUBLE), 6) first, round(avg(embedding[64]::DOUBLE), 6) last FROM embeddings GROUP BY 1")
def centroids(spark, d):
    s = rerank.vector_sums(table(spark, d, "embeddings"), "label")
    return s.select("label", "n", rounded(F.get("total", F.lit(0)), 6).alias("first"), rounded(F.get("total", F.lit(63)) / F.col("n"), 6).alias("last"))


_LOO = """ref AS (SELECT ref_id, artist, d, sum(e[d]) s, count(*) n FROM seg, range(1, 65) t(d) GROUP BY 1, 2, 3),
 art AS (SELECT artist, d, sum(s) s, sum(n) n FROM ref GROUP BY 1, 2),
 loo AS (SELECT ref_id, r.artist, list(CASE WHEN a.n > r.n THEN (a.s - r.s) / (a.n - r.n) ELSE 0::DOUBLE END ORDER BY d) mu FROM ref r JOIN art a USING (artist, d) GROUP BY 1, 2)"""


@register("AGG-21 AGG-22", with_clips(1, 0.8) + ", " + _LOO + " SELECT ref_id, artist, list_transform(mu, lambda x: round(x, 6)) centroid FROM loo")
def leave_one_out(spark, d):
    return rerank.leave_one_out(segments(spark, d)).select("ref_id", "artist", F.transform("centroid", lambda x: rounded(x, 6)).alias("centroid"))


_BITS = "('0x' || substr(sha256({}), 1, 13))::BIGINT"
_CONTROLS = f""", place AS (SELECT *, row_number() OVER (ORDER BY artist, h, ref_id) - 1 n FROM (SELECT *, {_BITS.format("'20260512:' || ref_id")} h FROM loo)),
 span AS (SELECT artist, min(n) lo, count(*) own FROM place GROUP BY 1),
 donor AS (SELECT p.ref_id, p.artist, o.ref_id donor, o.mu FROM place p JOIN span USING (artist) LEFT JOIN place o ON o.n = (lo + own + p.h % greatest((SELECT count(*) FROM loo) - own, 1)) % (SELECT count(*) FROM loo) AND own < (SELECT count(*) FROM loo)),
 noise AS (SELECT ref_id, artist, mu, list_transform(range(1, len(mu) + 1), lambda d: sqrt(-2 * ln(({_BITS.format("'20260513:0:' || ref_id || ':' || d")} + 1) / 4503599627370497::DOUBLE)) * cos(2 * 3.141592653589793::DOUBLE * (({_BITS.format("'20260513:1:' || ref_id || ':' || d")} + 1) / 4503599627370497::DOUBLE))) z FROM loo),
 iso AS (SELECT ref_id, artist, list_transform(z, lambda x: x * sqrt(list_inner_product(mu, mu)) / greatest(sqrt(list_inner_product(z, z)), 1e-12)) mu FROM noise)"""


def _centroids(spark, d):
    own = rerank.leave_one_out(segments(spark, d))
    return {"own": own, "shuffled": rerank.shuffled(own, new_folder(spark)), "isotropic": rerank.isotropic(own)}


@register("RET-8 RET-9 VEC-4 JOIN-19 JOIN-20", with_search(3, 0.8, probe=100) + ", " + _LOO + _CONTROLS + """,
 v AS (SELECT 'alpha_' || printf('%.2f', a) variant, a::DOUBLE alpha, 'own' kind FROM (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3]) a) UNION ALL SELECT 'control_shuffled', 0.1, 'shuffled' UNION ALL SELECT 'control_isotropic', 0.1, 'isotropic'),
 mus AS (SELECT ref_id, 'own' kind, mu FROM loo UNION ALL SELECT ref_id, 'shuffled', mu FROM donor UNION ALL SELECT ref_id, 'isotropic', mu FROM iso),
 moved AS (SELECT g, variant, list_transform(list_zip(e, mu), lambda p: p[1] - alpha * p[2]) m FROM seg JOIN mus USING (ref_id) JOIN v USING (kind)),
 unit AS (SELECT g, variant, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) u FROM moved),
 s AS (SELECT query_id, variant, cand, round(avg(list_inner_product(q, u)), 6) score FROM cand JOIN clip USING (query_id) JOIN unit ON g = cand + q_off GROUP BY 1, 2, 3)
 SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, cand) rank FROM s QUALIFY rank <= 10""")  # fmt: skip
def sweep(spark, d):
    """Candidates are probed once (100 for each segment) and rescored for all nine variants."""
    q, lib, cands = _scores(spark, d, probe=100)
    return rerank.sweep(cands, q, lib, _centroids(spark, d))


@register("RET-10 JOIN-16", with_clips(1, 0.8) + ", " + _LOO + _CONTROLS + " SELECT ref_id, artist, donor, list_transform(mu, lambda x: round(x, 6)) centroid FROM donor")
def shuffled_control(spark, d):
    return _centroids(spark, d)["shuffled"].withColumn("centroid", F.transform("centroid", lambda x: rounded(x, 6)))


@register("VEC-6", with_clips(1, 0.8) + ", " + _LOO + _CONTROLS + " SELECT ref_id, artist, list_transform(mu, lambda x: round(x, 6)) centroid FROM iso")
def isotropic_control(spark, d):
    return _centroids(spark, d)["isotropic"].withColumn("centroid", F.transform("centroid", lambda x: rounded(x, 6)))


_ANCHORS = ", anchor AS (SELECT g id, e a FROM seg ORDER BY sha256('20260513:' || g), g LIMIT 4096), centre AS (SELECT query_id, list(m ORDER BY d) c FROM (SELECT query_id, d, avg(q[d]) m FROM clip, range(1, 65) t(d) GROUP BY 1, 2) GROUP BY 1)"


def _anchors(spark, d):
    """The sample of RET-13."""
    return uniform_sample(segments(spark, d), "global_idx", rerank.MOST_ANCHORS, 20260513).select(F.col("global_idx").alias("anchor_id"), "embedding")


@register("RET-11 WIN-7 QRK-4", with_search(3, 0.8) + _ANCHORS + """, z AS (SELECT query_id, sum(exp(list_inner_product(c, a) / 0.05)) z FROM centre, anchor GROUP BY 1)
 SELECT query_id, cand, rank, round(exp(score / 0.05) / z, 6)::DOUBLE score FROM ranked JOIN z USING (query_id)""")  # fmt: skip
def inverted_softmax(spark, d):
    q, lib, cands = _scores(spark, d)
    ranked = R.top_k(R.rescore(cands, q, lib), 10)
    return rerank.inverted_softmax(ranked, _anchors(spark, d), q).withColumn("score", rounded(F.col("score"), 6)).select("query_id", "cand", "rank", "score")


@register("RET-12 TOPK-3", with_search(3, 0.8) + _ANCHORS.replace(" ORDER BY sha256('20260513:' || g), g LIMIT 4096", "") + """,
 qa AS (SELECT query_id, round(list_inner_product(c, a), 6) ip, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(c, a), 6) DESC, id) n FROM centre, anchor QUALIFY n <= 10),
 ra AS (SELECT g cand, round(list_inner_product(e, a), 6) ip, row_number() OVER (PARTITION BY g ORDER BY round(list_inner_product(e, a), 6) DESC, id) n FROM seg, anchor WHERE g IN (SELECT cand FROM scored) QUALIFY n <= 10),
 s AS (SELECT query_id, cand, round(score - (qm + rm) / 2, 6) score FROM scored JOIN (SELECT query_id, avg(ip) qm FROM qa GROUP BY 1) USING (query_id) JOIN (SELECT cand, avg(ip) rm FROM ra GROUP BY 1) USING (cand))

 SELECT query_id, cand, round(score, 3) score FROM s""")  # fmt: skip
def csls(spark, d):
    """Every segment is an anchor."""
    q, lib, cands = _scores(spark, d)
    return rerank.csls(R.rescore(cands, q, lib), lib.select(F.col("global_idx").alias("anchor_id"), "embedding"), q, lib).select("query_id", "cand", rounded(F.col("score"), 3).alias("score"))


@register("AGG-37", "SELECT count(*) n, max(vec_id) = count(*) - 1 contiguous, max(abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1)) < 1e-5 unit, min(len(embedding)) dim FROM embeddings")
def index_checks(spark, d):
    return segments(spark, d).agg(F.count("*").alias("n"), (F.max("global_idx") == F.count("*") - 1).alias("contiguous"), (F.max(F.abs(V.norm(F.col("embedding")) - 1)) < 1e-5).alias("unit"), F.min(F.size("embedding")).alias("dim"))


@register("RET-14 FLT-10", with_search(3, 0.8, k=5) + "SELECT query_id, rank, ref_id, score, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.8 THEN 'MATCH' ELSE 'NO_MATCH' END verdict FROM ranked JOIN seg ON g = cand")
def identify(spark, d):
    found = R.sequence_search(clips(spark, d, 3, 0.8), segments(spark, d), k=5)
    return found.join(segments(spark, d).select(F.col("global_idx").alias("cand"), "ref_id"), "cand").select("query_id", "rank", "ref_id", "score", calibrate.ladder(F.col("score"), 0.9, 0.8).alias("verdict"))


@register("RET-13 SMP-5", "SELECT vec_id FROM embeddings ORDER BY sha256('20260513:' || vec_id), vec_id LIMIT 4096")
def anchor_pool(spark, d):
    return uniform_sample(table(spark, d, "embeddings"), "vec_id", rerank.MOST_ANCHORS, 20260513).select("vec_id")


@register("JOIN-21.events", """WITH p AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 t, event_id % 512 f FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) n FROM p)
 SELECT a.user_id, a.event_id anchor, b.event_id target, (a.f << 23) | (b.f << 14) | least(b.t - a.t, 16383) hash FROM o a JOIN o b ON a.user_id = b.user_id AND b.n BETWEEN a.n + 1 AND a.n + 3""")  # fmt: skip
def peak_pairs(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = table(spark, d, "events").select("user_id", "event_id", F.floor(micros(F.col("ts")) / 1_000_000).alias("t"), (F.col("event_id") % 512).alias("f"))
    later = F.array(*[F.lead(F.struct("event_id", "t", "f"), i).over(order) for i in (1, 2, 3)])
    pairs = p.withColumn("b", later).select("user_id", "event_id", "t", "f", F.explode("b").alias("b")).where("b is not null")
    code = F.shiftleft("f", 23).bitwiseOR(F.shiftleft("b.f", 14)).bitwiseOR(F.least(F.col("b.t") - F.col("t"), F.lit(16383)))
    return pairs.select("user_id", F.col("event_id").alias("anchor"), F.col("b.event_id").alias("target"), code.alias("hash"))


@register("VEC-16.mel", "SELECT event_id, round(2595 * log10(1 + value / 700), 6) mel FROM events WHERE value >= 0")
def mel(spark, d):
    return table(spark, d, "events").where("value >= 0").select("event_id", F.round(2595 * F.log10(1 + F.col("value") / 700), 6).alias("mel"))
