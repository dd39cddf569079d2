"""Queries of spectra, landmarks, stored hashes and written indexes.

The signal of a recording is its vectors' components, one after the other.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import hash_store, landmarks as L, vector_index
from ..operators import retrieval as R
from ..sources.folders import new_folder
from .registry import register, table


def chunks(spark, d):
    """Each vector is 64 samples of its recording."""
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("clip_id"), (F.col("vec_id") % 25 * 64).alias("at"), F.col("embedding").cast("array<double>").alias("samples"))


_SAMPLES = "smp AS (SELECT vec_id // 25 clip_id, (vec_id % 25) * 64 + i - 1 pos, embedding[i]::DOUBLE x FROM embeddings, range(1, 65) t(i))"


def _spectra(samples: str = "smp", out: str = "spec") -> str:
    """CTE of magnitudes ``clip_id, frame, bin, v`` by the sum that defines the transform."""
    return f"""{out} AS (SELECT clip_id, frame, b bin, sqrt(power(sum(x * cos(2 * pi() * b * j / 64)), 2) + power(sum(x * sin(2 * pi() * b * j / 64)), 2)) v
 FROM (SELECT s.clip_id, k frame, pos - 32 * k j, x FROM {samples} s JOIN (SELECT clip_id, unnest(range((max(pos) + 1 - 64) // 32 + 1)) k FROM {samples} GROUP BY 1) f ON f.clip_id = s.clip_id AND pos BETWEEN 32 * k AND 32 * k + 63), range(33) t(b) GROUP BY 1, 2, 3)"""


def _peaks(spec: str = "spec", out: str = "peak") -> str:
    return f"""{out} AS (SELECT clip_id, frame, bin, v, row_number() OVER (PARTITION BY clip_id ORDER BY frame, bin) n FROM (SELECT *, max(near) OVER (PARTITION BY clip_id, frame ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) most
 FROM (SELECT *, max(v) OVER (PARTITION BY clip_id, bin ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) near FROM (SELECT clip_id, frame, bin, round(v, 6) v FROM {spec}))) WHERE v >= most AND v > 0)"""


def _pairs(peak: str = "peak", out: str = "pair") -> str:
    return f"{out} AS (SELECT a.clip_id, (a.bin << 23) | (b.bin << 14) | (b.frame - a.frame) hash, a.frame t FROM {peak} a JOIN {peak} b ON a.clip_id = b.clip_id AND b.n BETWEEN a.n + 1 AND a.n + 3 AND b.frame - a.frame <= 63)"


_MEL = """edge AS (SELECT i, 700 * (power(10, i * (2595 * log10(1 + 4000 / 700::DOUBLE)) / 17 / 2595) - 1) e FROM range(18) t(i)),
 weight AS (SELECT l.i + 1 band, b bin, greatest(0, least((b * 125 - l.e) / (m.e - l.e), (h.e - b * 125) / (h.e - m.e))) w FROM edge l JOIN edge m ON m.i = l.i + 1 JOIN edge h ON h.i = l.i + 2, range(33) t(b))"""


@register("VEC-16", f"""WITH {_SAMPLES}, {_spectra()}, {_MEL}, e AS (SELECT clip_id, frame, band, sum(w * v * v) p FROM spec JOIN weight USING (bin) GROUP BY 1, 2, 3)
 SELECT clip_id, frame, energy, mel FROM (SELECT clip_id, frame, round(sum(v * v), 4) energy FROM spec GROUP BY 1, 2) JOIN (SELECT clip_id, frame, list(round(10 * log10(greatest(p, 1e-10)), 4) ORDER BY band) mel FROM e GROUP BY 1, 2) USING (clip_id, frame)""")  # fmt: skip
def spectra(spark, d):
    """Energy of each frame and its logarithmic mel bands, at 8,000 samples a second."""
    energy = F.aggregate("magnitudes", F.lit(0.0), lambda a, v: a + v * v)
    power = L.spectrogram(chunks(spark, d)).select("clip_id", "frame", rounded(energy, 4).alias("energy"))
    return power.join(L.log_mel(chunks(spark, d), 8000.0), ["clip_id", "frame"]).withColumn("mel", F.transform("mel", lambda x: rounded(x, 4)))


@register("WIN-8", f"WITH {_SAMPLES}, {_spectra()}, {_peaks()} SELECT clip_id, frame, bin, v magnitude FROM peak")
def spectral_peaks(spark, d):
    """Local maxima of 7 bins by 31 frames."""
    return L.peaks(chunks(spark, d))


@register("JOIN-21 VEC-14", f"WITH {_SAMPLES}, {_spectra()}, {_peaks()}, {_pairs()} SELECT clip_id, hash, t FROM pair")
def landmark_pairs(spark, d):
    return L.pair_hashes(L.peaks(chunks(spark, d)))


@register("VEC-15", f"""WITH {_SAMPLES}, {_spectra()}, {_peaks()}
 SELECT a.clip_id, ((b.bin - a.bin + 512) << 20) | ((c.bin - b.bin + 512) << 10) | least(63, (b.frame - a.frame) * 64 // (c.frame - a.frame)) hash, a.frame t
 FROM peak a JOIN peak b ON b.clip_id = a.clip_id AND b.n BETWEEN a.n + 1 AND a.n + 4 JOIN peak c ON c.clip_id = a.clip_id AND c.n BETWEEN b.n + 1 AND a.n + 4 WHERE c.frame > a.frame AND c.frame - a.frame <= 63""")  # fmt: skip
def landmark_triplets(spark, d):
    return L.triplet_hashes(L.peaks(chunks(spark, d)))


#: A clip of a recording: 640 samples from sample 320 on, so its frame 0 is the recording's frame 10.
_FROM, _CLIP, _AT, _WINDOW = 320, 640, 10, 2


@register("EVAL-11", f"""WITH {_SAMPLES}, {_spectra()}, {_peaks()}, {_pairs()},
 cut AS (SELECT clip_id, pos - {_FROM} pos, x FROM smp WHERE pos BETWEEN {_FROM} AND {_FROM + _CLIP - 1}), {_spectra('cut', 'cspec')}, {_peaks('cspec', 'cpeak')}, {_pairs('cpeak', 'cpair')},
 vote AS (SELECT q.clip_id query_id, r.clip_id ref_id, r.t - q.t shift, count(*) votes FROM (SELECT DISTINCT * FROM cpair) q JOIN (SELECT DISTINCT * FROM pair WHERE clip_id % 2 = 0) r USING (hash) GROUP BY 1, 2, 3),
 best AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, ref_id, shift) = 1)
 SELECT c.clip_id query_id, b.ref_id, b.shift, coalesce(b.votes, 0) votes, CASE WHEN c.clip_id % 2 = 0 THEN CASE WHEN b.ref_id IS NULL THEN 'no match' WHEN b.ref_id <> c.clip_id THEN 'wrong recording' WHEN abs(b.shift - {_AT}) > {_WINDOW} THEN 'wrong place' ELSE 'match' END
  ELSE CASE WHEN b.ref_id IS NULL THEN 'no match' WHEN b.votes * 4 > coalesce(own.votes, 0) THEN 'false match' ELSE 'weak match' END END verdict
 FROM (SELECT DISTINCT clip_id FROM smp) c LEFT JOIN best b ON b.query_id = c.clip_id LEFT JOIN best own ON own.query_id = b.ref_id""")  # fmt: skip
def smoke(spark, d):
    """Clips of stored recordings must be found in their place, and clips of others not as strongly as a quarter of that."""
    signal = chunks(spark, d)
    stored = L.pair_hashes(L.peaks(signal.where("clip_id % 2 = 0"))).withColumnRenamed("clip_id", "ref_id")
    refs = signal.where("clip_id % 2 = 0").groupBy(F.col("clip_id").alias("ref_id")).agg(F.md5(F.col("clip_id").cast("string")).alias("source_md5"), F.sum(F.size("samples")).cast("double").alias("duration_sec"))
    store = hash_store.create(spark, refs)
    hash_store.insert(store, refs, stored)
    part = signal.where((F.col("at") >= _FROM) & (F.col("at") < _FROM + _CLIP)).withColumn("at", F.col("at") - _FROM)
    clips = L.pair_hashes(L.peaks(part)).withColumnRenamed("clip_id", "query_id")
    first = Window.partitionBy("query_id").orderBy(F.desc("votes"), "ref_id", "shift")
    best = hash_store.votes(store, clips).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    own = best.select(F.col("query_id").alias("ref_id"), F.col("votes").alias("own"))
    every = signal.select(F.col("clip_id").alias("query_id")).distinct().join(best, "query_id", "left").join(own, "ref_id", "left")
    none, held = F.col("ref_id").isNull(), F.col("query_id") % 2 == 0
    verdict = F.when(none, "no match").when(held & (F.col("ref_id") != F.col("query_id")), "wrong recording").when(held & (F.abs(F.col("shift") - _AT) > _WINDOW), "wrong place").when(held, "match")
    verdict = verdict.when(F.col("votes") * 4 > F.coalesce("own", F.lit(0)), "false match").otherwise("weak match")
    return every.select("query_id", "ref_id", "shift", F.coalesce("votes", F.lit(0)).alias("votes"), verdict.alias("verdict"))


_GRAMS = """h AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: struct_pack(h := md5(array_to_string(w[i:i+2], ' ')), t := i - 1)) l FROM (SELECT doc_id, string_split(text, ' ') w FROM documents)),
 lib AS (SELECT DISTINCT doc_id ref_id, x.h hash, x.t t FROM (SELECT doc_id, unnest(l) x FROM h)),
 k AS (SELECT item_id, list_transform(range(1, len(w) - 1), lambda i: struct_pack(h := md5(array_to_string(w[i:i+2], ' ')), t := i - 1)) l FROM (SELECT item_id, string_split(text, ' ') w FROM benchmark)),
 qry AS (SELECT DISTINCT item_id query_id, x.h hash, x.t t FROM (SELECT item_id, unnest(l) x FROM k)),
 vote AS (SELECT query_id, ref_id, lib.t - qry.t shift, count(*) votes FROM qry JOIN lib USING (hash) GROUP BY 1, 2, 3),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_id, ref_id ORDER BY votes DESC, shift) n FROM vote QUALIFY n = 1),
 top AS (SELECT query_id, ref_id, shift, votes, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, ref_id) rank FROM best QUALIFY rank <= 10)"""


def text_store(spark, docs):
    """An empty store with buckets for the words of ``text``, of six characters or more on average."""
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    return hash_store.create(spark, docs, hash_store.buckets_for(chars // 6))


def _library(spark, d):
    """All documents stored by the hashes of their word triples, and the hashes of the benchmark's items."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), "text", F.md5("text").alias("source_md5"), F.col("n_chars").cast("double").alias("duration_sec"))
    store = text_store(spark, docs)
    hash_store.insert(store, docs, R.word_hashes(docs, "ref_id"))
    return store, R.word_hashes(table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id")


@register("JOIN-9 AGG-24", "WITH " + _GRAMS + " SELECT query_id, ref_id, shift, votes FROM vote")
def votes(spark, d):
    return hash_store.votes(*_library(spark, d))


@register("RET-6 AGG-23 TOPK-4", "WITH " + _GRAMS + " SELECT query_id, ref_id, shift, votes, rank FROM top")
def collapsed(spark, d):
    return R.best_per_ref(hash_store.votes(*_library(spark, d)))


@register("RET-5 AGG-25", "WITH " + _GRAMS + """ SELECT query_id, ref_id, shift, votes, rank, nq query_hashes, nr ref_hashes, votes / nq input_confidence, votes / nr fingerprinted_confidence
 FROM top JOIN (SELECT query_id, count(*) nq FROM qry GROUP BY 1) USING (query_id) JOIN (SELECT ref_id, count(*) nr FROM lib GROUP BY 1) USING (ref_id)""")  # fmt: skip
def matched(spark, d):
    store, q = _library(spark, d)
    return hash_store.confidences(store, R.best_per_ref(hash_store.votes(store, q)), q)


@register("SNK-4 RET-16", "WITH " + _GRAMS + f""", n AS (SELECT ref_id, count(*) n FROM lib GROUP BY 1),
 r AS (SELECT doc_id ref_id, n_chars, n, doc_id % 2 batch, CASE WHEN doc_id % 17 = 3 THEN '{hash_store.MISSING_MD5}' WHEN n IS NULL THEN '{hash_store.NO_HASHES}' END reason FROM documents LEFT JOIN n ON ref_id = doc_id)
 SELECT ref_id, row_number() OVER (ORDER BY batch, n_chars DESC, ref_id) song_id, n n_hashes, n n_stored, NULL::VARCHAR reason FROM r WHERE reason IS NULL UNION ALL SELECT ref_id, NULL, NULL, NULL, reason FROM r WHERE reason IS NOT NULL""")  # fmt: skip
def stored_hashes(spark, d):
    """Half of the documents stored first, and then all: ids, hashes as noted and as counted, and what could not be stored."""
    md5 = F.when(F.col("doc_id") % 17 == 3, F.substring(F.md5("text"), 1, 31)).otherwise(F.md5("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), "text", md5.alias("source_md5"), F.col("n_chars").cast("double").alias("duration_sec"))
    store = text_store(spark, docs)
    for batch in (docs.where("ref_id % 2 = 0"), docs):
        hash_store.insert(store, batch, R.word_hashes(batch, "ref_id"))
    held = store.table("hashes").groupBy("song_id").agg(F.count("*").alias("n_stored"))
    songs = store.songs().join(held, "song_id").select("ref_id", "song_id", "n_hashes", "n_stored", F.lit(None).cast("string").alias("reason"))
    missing = [F.lit(None).cast("long").alias(c) for c in ("song_id", "n_hashes", "n_stored")]
    return songs.unionByName(store.failures().select("ref_id", *missing, "reason"))


_BANDS = """band AS (SELECT b bin, least(15, floor(16 * (2595 * log10(1 + b / 7::DOUBLE)) / (2595 * log10(1 + 32 / 7::DOUBLE)))::INT) g FROM range(33) t(b)),
 code AS (SELECT clip_id, frame, list(x ORDER BY g) e FROM (SELECT clip_id, frame, g, ln(1 + sum(v)) x FROM spec JOIN band USING (bin) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 size AS (SELECT clip_id, count(*) n FROM code GROUP BY 1), base AS (SELECT clip_id, sum(n) OVER (ORDER BY clip_id) - n base FROM size)"""


@register("RET-1", f"""WITH {_SAMPLES}, {_spectra()}, {_BANDS}
 SELECT (base + frame)::BIGINT global_idx, clip_id ref_id, frame segment_idx, frame * 0.5::DOUBLE segment_start_sec, list_transform(e, lambda x: round((x / sqrt(list_inner_product(e, e)))::FLOAT::DOUBLE, 4)) embedding FROM code JOIN base USING (clip_id)""")  # fmt: skip
def built_index(spark, d):
    """All recordings encoded, numbered and written, and the index opened and verified."""
    folder = new_folder(spark)
    vector_index.build(chunks(spark, d), folder)
    return vector_index.open_index(spark, folder).withColumn("embedding", F.transform("embedding", lambda x: rounded(x.cast("double"), 4)))


@register("RET-2", """WITH s AS (SELECT vec_id // 25 r, count(*) * 64 n FROM embeddings GROUP BY 1), f AS (SELECT r, (n - 64) // 32 + 1 n FROM s)
 SELECT v AS version, x.reused, count(*) n_refs, sum(n)::BIGINT n_segments, 16 dim, sum(n)::BIGINT - 1 AS last FROM f, (SELECT unnest([1, 1, 2]) v, unnest([false, true, false]) reused) x GROUP BY 1, 2""")
def reused_index(spark, d):
    """Built, reused, and built anew for other samples: the manifests, which the vectors were held against."""
    folder, signal = new_folder(spark), chunks(spark, d)
    rows = []
    for own in (signal, signal, signal.withColumn("samples", F.transform("samples", lambda x: x * 2))):
        vectors, reused = vector_index.reuse_or_build(own, folder)
        about = vector_index.manifest(spark, folder)
        rows.append(vectors.limit(0).select(F.lit(1)).agg(F.lit(about["version"]).alias("version"), F.lit(reused).alias("reused"), *[F.lit(about[k]).alias(k) for k in ("n_refs", "n_segments", "dim", "last")]))
    return rows[0].union(rows[1]).union(rows[2])

