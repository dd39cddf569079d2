"""Queries of cells and seeds, reports, exports, cuts at another rate, annotations and the contract of systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import variants as J
from ..functions.stats import rounded
from ..operators import hash_store, matcher, signals, vector_index
from ..operators import landmarks as L
from ..operators import metrics as M
from ..operators import retrieval as R
from ..sources import cells, checksums, media, ranged
from ..sources.folders import new_folder
from .fixtures import clips, line_parts, manifest, results, segments, with_eval, with_search
from .landmarks import _BANDS, _SAMPLES, _pairs, _peaks, _spectra, chunks
from .registry import register, table

_CELLS = ("main_1s", "main_3s", "main_5s", "main_10s", "ablation_3s", "ablation_7s")
_RUNS = [("base", c, 0) for c in _CELLS] + [("other", c, s) for c in _CELLS for s in (1, 2, 3)]


def _runs(spark, d) -> DataFrame:
    """Results of all systems; a task sorts those of ``LINES`` lines at most, about, whatever the table's size."""
    n = line_parts(spark, d)
    cell = manifest(spark, d, n).select("query_id", "split", "length_s")
    parts = [results(spark, d, i, n).join(cell, "query_id").withColumns({"system": F.lit(name), "seed": F.lit(seed)}) for i, (name, seed) in enumerate((("base", 0), ("other", 1), ("other", 2)))]
    return reduce(DataFrame.unionByName, parts)


@register("SRC-4 SRC-5 SRC-21", with_eval(0, 1, 2) + f""", run AS (SELECT unnest({[r[0] for r in _RUNS]}) AS system, unnest({[r[1] for r in _RUNS]}) cell, unnest({[r[2] for r in _RUNS]}) seed),
 r AS (SELECT query_id, rank, 'base' AS system, 0 seed FROM r0 UNION ALL SELECT query_id, rank, 'other', 1 FROM r1 UNION ALL SELECT query_id, rank, 'other', 2 FROM r2),
 n AS (SELECT system, seed, split || '_' || length_s || 's' cell, count(*) n, count_if(rank = 1) firsts FROM r JOIN manifest USING (query_id) GROUP BY 1, 2, 3)
 SELECT system, cell, seed, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END state, n, firsts FROM run LEFT JOIN n USING (system, cell, seed)""")  # fmt: skip
def cells_and_seeds(spark, d):
    """Runs read by system, cell and seed from their own folders; a cell and a seed that nobody ran are said to be missing."""
    folder = new_folder(spark)
    cells.write_runs(_runs(spark, d), folder)
    found, missing = cells.read_runs(spark, folder, _RUNS)
    name = F.concat("split", F.lit("_"), "length_s", F.lit("s"))
    there = found.groupBy("system", name.alias("cell"), "seed").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("firsts")).withColumn("state", F.lit("ok"))
    gone = spark.createDataFrame(missing, "system string, cell string, seed int").withColumns({"state": F.lit("missing"), "n": F.lit(None).cast("long"), "firsts": F.lit(None).cast("long")})
    return there.unionByName(gone)


@register("SNK-15", "SELECT 'r' || r_regionkey AS name, CASE WHEN n IS NULL THEN 'missing' ELSE 'copied' END state, n AS rows, n AS read FROM region LEFT JOIN (SELECT n_regionkey, count(*) n FROM nation WHERE n_regionkey % 2 = 0 GROUP BY 1) ON n_regionkey = r_regionkey")
def exported(spark, d):
    """Data sets of all regions asked for, of which every second is there: what was copied, and rows read again."""
    folder, to = new_folder(spark), new_folder(spark)
    table(spark, d, "nation").where("n_regionkey % 2 = 0").withColumn("part", F.col("n_regionkey")).write.partitionBy("part").parquet(folder)
    names = {f"r{k}": f"{folder}/part={k}" for (k,) in table(spark, d, "region").select("r_regionkey").collect()}
    done = cells.export(spark, names, to)
    read = sources.listing(spark, to).select(F.regexp_extract("path", r"/(r\d+)/", 1).alias("name")).distinct()
    counted = spark.read.option("recursiveFileLookup", True).parquet(to).groupBy(F.concat(F.lit("r"), "n_regionkey").alias("name")).agg(F.count("*").alias("read"))
    return done.join(read.join(counted, "name"), "name", "left")


_CARD = "count(*) n, count_if(first_rank = 1) hits, round(sum(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE / first_rank ELSE 0 END) / count(*), 6) mrr"


def _first(system: int) -> str:
    return f"""f{system} AS (SELECT m.split, m.length_s, f.first_rank FROM manifest m LEFT JOIN (SELECT query_id, min(CASE WHEN predicted_ref_id = ref_id THEN rank END) first_rank FROM r{system} JOIN manifest USING (query_id) GROUP BY 1) f USING (query_id)),
 c{system} AS (SELECT split, length_s, {_CARD} FROM f{system} GROUP BY 1, 2)"""


def _card(spark, d, system):
    first = F.col("first_rank")
    mrr = F.round(F.sum(F.when(first <= 10, 1 / first).otherwise(0.0)) / F.count("*"), 6)
    return M.per_query(results(spark, d, system), manifest(spark, d)).groupBy("split", "length_s").agg(F.count("*").alias("n"), F.count_if(first == 1).alias("hits"), mrr.alias("mrr"))


@register("EVAL-9", with_eval(0, 1, 2) + f""", {_first(0)}, {_first(1)}, {_first(2)}
 SELECT split, length_s, n, c0.hits hits_0, c1.hits hits_1, c2.hits hits_2, c0.mrr mrr_0, c1.mrr mrr_1, c2.mrr mrr_2, greatest(c0.hits, c1.hits, c2.hits) best FROM c0 JOIN c1 USING (split, length_s, n) JOIN c2 USING (split, length_s, n)""")  # fmt: skip
def assembled(spark, d):
    """A report of each system as JSON files, read again together as one table with a column for each system."""
    folder = new_folder(spark)
    for system in range(3):
        cells.write_json(_card(spark, d, system), f"{folder}/system={system}", "split")
    read = cells.read_json(spark, [f"{folder}/system={i}" for i in range(3)], "length_s int, n long, hits long, mrr double")
    read = read.select("*", F.regexp_extract("path", r"system=(\d+)", 1).alias("system"), F.regexp_extract("path", r"split=([^/]+)", 1).alias("split"))
    out = read.groupBy("split", "length_s", "n").agg(*[F.max(F.when(F.col("system") == str(i), F.col(c))).alias(f"{c}_{i}") for c in ("hits", "mrr") for i in range(3)])
    return out.withColumn("best", F.greatest(*[f"hits_{i}" for i in range(3)]))


@register("SNK-2", with_eval(0) + f""", {_first(0)} SELECT '{{"split":"' || split || '","length_s":' || length_s || ',"n":' || n || ',"hits":' || hits || '}}' AS line FROM c0""")
def statistics_as_json(spark, d):
    """Statistics written as JSON, and the lines of the files."""
    folder = new_folder(spark)
    cells.write_json(_card(spark, d, 0).drop("mrr"), folder)
    return sources.read_lines(spark, folder).select(F.col("value").alias("line"))


@register("SNK-7", with_eval(0, 1) + f""", {_first(0)}, {_first(1)}, t AS (SELECT row_number() OVER (ORDER BY split, length_s) k, * FROM (SELECT split, length_s, c0.n, c0.hits a, c1.hits b FROM c0 JOIN c1 USING (split, length_s))),
 m AS (SELECT row_number() OVER (ORDER BY split) k, * FROM (SELECT split, sum(n)::BIGINT n, sum(n - a)::BIGINT x FROM t GROUP BY 1)), w AS (SELECT row_number() OVER (ORDER BY lang) k, * FROM (SELECT lang, count(*) n, count(DISTINCT source) s FROM documents GROUP BY 1))
 SELECT 'cells' report, k + 4 place, '| ' || split || ' | ' || length_s || ' s | ' || n || ' | ' || a || ' | ' || b || ' | ' || printf('%+d', b - a) || ' |' AS line FROM t
 UNION ALL SELECT 'misses', k + 4, '| ' || split || ' | ' || n || ' | ' || x || ' |' FROM m UNION ALL SELECT 'corpora', k + 4, '| ' || lang || ' | ' || n || ' | ' || s || ' |' FROM w
 UNION ALL SELECT report, place, line FROM (SELECT unnest(['cells', 'cells', 'cells', 'cells', 'misses', 'misses', 'misses', 'misses', 'corpora', 'corpora', 'corpora', 'corpora']) report, unnest([1, 2, 3, 4, 1, 2, 3, 4, 1, 2, 3, 4]) place,
  unnest(['# Hits by cell', '', '| split | length | n | base | other | delta |', '|---|---|---|---|---|---|', '# Misses', '', '| split | n | misses |', '|---|---|---|', '# Corpora', '', '| corpus | tracks | artists |', '|---|---|---|']) line)""")  # fmt: skip
def reports(spark, d):
    """Three reports in Markdown: hits by cell, misses by split, and corpora."""
    a, b = (_card(spark, d, s).select("split", "length_s", "n", F.col("hits").alias(f"h{s}")) for s in (0, 1))
    rows = a.join(b.drop("n"), ["split", "length_s"])
    own = rows.select("split", F.col("length_s").alias("length"), "n", F.col("h0").alias("base"), F.col("h1").alias("other"), (F.col("h1") - F.col("h0")).alias("delta"))
    misses = rows.groupBy("split").agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("h0")).alias("misses"))
    corpora = table(spark, d, "documents").groupBy(F.col("lang").alias("corpus")).agg(F.count("*").alias("tracks"), F.countDistinct("source").alias("artists"))
    whole = [
        ("cells", cells.markdown(own, "Hits by cell", {"split": "%s", "length": "%d s", "n": "%d", "base": "%d", "other": "%d", "delta": "%+d"}, ["split", "length"])),
        ("misses", cells.markdown(misses, "Misses", {"split": "%s", "n": "%d", "misses": "%d"}, ["split"])),
        ("corpora", cells.markdown(corpora, "Corpora", {"corpus": "%s", "tracks": "%d", "artists": "%d"}, ["corpus"])),
    ]
    return reduce(DataFrame.unionByName, [t.withColumn("report", F.lit(name)) for name, t in whole])


def _low_pass(source: str, n: str, share: float, step: float) -> str:
    """Samples ``v`` of ``source`` (``q, j, x``) at another rate: a sum over the taps around each place."""
    reach = signals.CROSSINGS / share
    away = f"(i * {step}::DOUBLE - j)"
    sinc = f"CASE WHEN {away} = 0 THEN 1 ELSE sin(pi() * {share}::DOUBLE * {away}) / (pi() * {share}::DOUBLE * {away}) END"
    return f"SELECT q, i, sum(x * {share}::DOUBLE * ({sinc}) * (0.5 + 0.5 * cos(pi() * {away} / {reach}::DOUBLE))) v FROM {source} JOIN {n} USING (q) WHERE abs({away}) < {reach}::DOUBLE GROUP BY 1, 2"


_CUT, _FROM = 500, 150


@register("SMP-7 SRC-9", f"""WITH {_SAMPLES}, src AS (SELECT clip_id q, pos - {_FROM} j, x FROM smp WHERE pos BETWEEN {_FROM} AND {_FROM + _CUT - 1}), n AS (SELECT q, unnest(range(count(*) * 3 // 4)) i FROM src GROUP BY 1),
 o AS ({_low_pass('src', 'n', 0.75, 4 / 3)}) SELECT q query_id, count(*) n, round(sum(v * v), 6) energy, list(round(v, 6) ORDER BY i) samples FROM o GROUP BY 1""")  # fmt: skip
def recut(spark, d):
    """A range of each recording, cut from its chunks, at three quarters of the rate."""
    asked = chunks(spark, d).select("clip_id").distinct().select(F.col("clip_id").alias("query_id"), "clip_id", F.lit(_FROM).alias("start"), F.lit(_CUT).alias("length"))
    out = signals.resample(signals.cut(chunks(spark, d), asked, 64), 8000, 6000)
    energy = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)
    return out.select("query_id", F.size("samples").cast("long").alias("n"), rounded(energy, 6).alias("energy"), F.transform("samples", lambda v: rounded(v, 6)).alias("samples"))


@register("SRC-8", f"""WITH {_SAMPLES}, src AS (SELECT clip_id q, pos j, (trunc(greatest(least(x * 32767, 32767), -32768)) + trunc(greatest(least(x / 2 * 32767, 32767), -32768))) / 2 / 32768 x FROM smp), n AS (SELECT q, unnest(range(count(*) // 2)) i FROM src GROUP BY 1),
 o AS ({_low_pass('src', 'n', 0.5, 2.0)}) SELECT 'clip' || q AS path, 2 channels, 8000 samplerate, count(*) n, list(round(v, 6) ORDER BY i) samples FROM o GROUP BY q""")  # fmt: skip
def decoded(spark, d):
    """Sound files of two channels: decoded, mixed to one, and taken to half the rate."""
    one = F.array_sort(F.collect_list(F.struct("at", "samples")))
    clip = chunks(spark, d).groupBy("clip_id").agg(F.flatten(F.transform(one, lambda c: c["samples"])).alias("samples"))
    both = F.flatten(F.transform("samples", lambda x: F.array(x, x / 2)))
    files = media.encode_wav(clip.select(F.concat(F.lit("clip"), "clip_id").alias("path"), both.alias("samples")), 8000, 2)
    out = signals.resample(media.decode_wav(files).where("error is null").drop("error"), 8000, 4000)
    return out.select("path", "channels", "samplerate", F.size("samples").cast("long").alias("n"), F.transform("samples", lambda v: rounded(v, 6)).alias("samples"))


@register("SRC-12", "SELECT conv_id, turn * 10 AS start, turn * 10 + length(text) % 10 AS stop, role AS label FROM conversations")
def annotated(spark, d):
    """Sections of each conversation from JSON text of two forms: lists of intervals and labels, or a list of objects."""
    start, span = F.col("turn") * 10, F.char_length("text") % 10
    lists = F.to_json(F.struct(F.collect_list(F.array(start, start + span)).alias("intervals"), F.collect_list("role").alias("labels")))
    objects = F.to_json(F.collect_list(F.struct(start.alias("time"), span.alias("duration"), F.col("role").alias("value"))))
    texts = table(spark, d, "conversations").groupBy("conv_id").agg(lists.alias("lists"), objects.alias("objects"))
    parsed = texts.select("conv_id", J.parse(F.when(F.col("conv_id") % 2 == 0, F.col("lists")).otherwise(F.col("objects"))).alias("v"))
    return parsed.select("conv_id", F.inline(J.sections(F.col("v")))).select("conv_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "label")


def _page_files(spark, d, folder) -> DataFrame:
    """The listing of a file for each page, which are written first."""
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("name"), F.encode("html", "UTF-8").alias("content"))
    return ranged.write_files(pages, folder)


@register("SRC-23", "SELECT count(*) n_files, sum(strlen(html) + 1)::BIGINT bytes, max(strlen(html) + 1)::BIGINT largest FROM pages")
def store_size(spark, d):
    """Bytes of a store of files, from its listing: contents aren't read."""
    return _page_files(spark, d, new_folder(spark)).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.max("length").alias("largest"))


@register("SNK-9.files SRC-16.files", "SELECT page_id::VARCHAR AS name, strlen(html) + 1 AS length, sha256(html || chr(10)) sha256 FROM pages")
def checksums_of_written_files(spark, d):
    """The listing of files that were written, with the checksum of each."""
    folder = new_folder(spark)
    files = _page_files(spark, d, folder)
    found = checksums.of_files(files) if ranged.writes(folder) else sources.artefacts(spark, folder, "part-*").withColumnRenamed("name", "path")
    return found.select(ranged.name_of("path").alias("name"), "length", "sha256")


@register("VEC-13 VEC-17 VEC-18 UDF-3", f"""WITH {_SAMPLES}, {_spectra()}, {_BANDS} SELECT clip_id, frame segment_idx, list_transform(e, lambda x: round((x / sqrt(list_inner_product(e, e)))::FLOAT::DOUBLE, 4)) embedding FROM code""")
def encoded_segments(spark, d):
    """Windows, batches through an encoder that each worker loads once, and unit length."""
    return vector_index.encode_segments(chunks(spark, d)).withColumn("embedding", F.transform("embedding", lambda x: rounded(x.cast("double"), 4)))


@register("QRK-16", "WITH c AS (SELECT vec_id // 25 i, count(*) * 64 n FROM embeddings GROUP BY 1) SELECT i clip_id, (ceil(n / 100)::BIGINT * 100 - 64) // 32 + 1 predicted, (n - 64) // 32 + 1 AS segments, (ceil(n / 100)::BIGINT * 100 - 64) // 32 >= (n - 64) // 32 bounded FROM c")
def predicted_segments(spark, d):
    """Segments as a rounded-up duration predicts them, and as there are."""
    samples = chunks(spark, d).groupBy("clip_id").agg(F.sum(F.size("samples")).alias("n"))
    there = vector_index.encode_segments(chunks(spark, d)).groupBy("clip_id").agg(F.count("*").alias("segments"))
    predicted = F.floor((F.ceil(F.col("n") / 100) * 100 - 64) / 32) + 1
    return samples.join(there, "clip_id").select("clip_id", predicted.alias("predicted"), "segments", (predicted >= F.col("segments")).alias("bounded"))


@register("UDF-6", with_search(3, 0.8, k=5) + f""", {_SAMPLES}, {_spectra()}, {_peaks()}, {_pairs()}, cut AS (SELECT clip_id, pos - 320 pos, x FROM smp WHERE pos BETWEEN 320 AND 959), {_spectra('cut', 'cspec')}, {_peaks('cspec', 'cpeak')}, {_pairs('cpeak', 'cpair')},
 vote AS (SELECT q.clip_id query_id, r.clip_id ref_id, r.t - q.t shift, count(*) votes FROM (SELECT DISTINCT * FROM cpair) q JOIN (SELECT DISTINCT * FROM pair) r USING (hash) GROUP BY 1, 2, 3),
 best AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY votes DESC, shift) = 1),
 top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, ref_id) rank, ref_id, votes, shift FROM best QUALIFY rank <= 5),
 q AS (SELECT DISTINCT clip_id query_id FROM smp), v AS (SELECT query_id, rank, cand // 25 ref_id, score, (cand % 25) * 0.5::DOUBLE ref_start FROM ranked)
 SELECT 'vectors' AS system, q.query_id::VARCHAR query_id, coalesce(rank, 0)::INT AS rank, ref_id::VARCHAR predicted_ref_id, score, ref_start FROM q LEFT JOIN v USING (query_id)
 UNION ALL SELECT 'hashes', q.query_id::VARCHAR, coalesce(rank, 0)::INT, ref_id::VARCHAR, votes::DOUBLE, shift * 0.5::DOUBLE FROM q LEFT JOIN top USING (query_id)""")  # fmt: skip
def two_systems(spark, d):
    """A search by vectors and one by stored hashes, behind one contract that both are held to."""
    signal = chunks(spark, d)
    queries = signal.select(F.col("clip_id").alias("query_id")).distinct()

    def vectors():
        lib = segments(spark, d)
        found = R.sequence_search(clips(spark, d, 3, 0.8), lib, k=5)
        named = found.join(lib.select(F.col("global_idx").alias("cand"), F.col("ref_id").alias("predicted_ref_id"), F.col("segment_start_sec").alias("ref_start")), "cand")
        return matcher.with_no_match(named, queries)

    def hashes():
        refs = signal.groupBy(F.col("clip_id").alias("ref_id")).agg(F.md5(F.first("clip_id").cast("string")).alias("source_md5"), F.sum(F.size("samples")).cast("double").alias("duration_sec"))
        store = hash_store.create(spark, refs)
        hash_store.insert(store, refs, L.pair_hashes(L.peaks(signal)).withColumnRenamed("clip_id", "ref_id"))
        part = signal.where((F.col("at") >= 320) & (F.col("at") < 960)).withColumn("at", F.col("at") - 320)
        found = R.best_per_ref(hash_store.votes(store, L.pair_hashes(L.peaks(part)).withColumnRenamed("clip_id", "query_id")), 5)
        named = found.select("query_id", "rank", F.col("ref_id").alias("predicted_ref_id"), F.col("votes").cast("double").alias("score"), (F.col("shift") * 0.5).alias("ref_start"))
        return matcher.with_no_match(named, queries)

    return matcher.run({"vectors": vectors, "hashes": hashes}, queries)
