"""Queries of files' headers and archives, values of any shape, encoder gates, probe splits, audits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions import variants as J
from ..operators import calibrate as C
from ..operators import components, gates, hash_store, quantiles, vector_index
from ..operators import retrieval as R
from ..sources import media, ranged
from ..sources.folders import new_folder
from ..streaming import state
from . import landmarks as L
from .fixtures import clips, segments, with_search
from .registry import register, table


def _recordings(spark, d):
    """``clip_id, samples`` of whole recordings."""
    one = F.array_sort(F.collect_list(F.struct("at", "samples")))
    return L.chunks(spark, d).groupBy("clip_id").agg(F.flatten(F.transform(one, lambda c: c["samples"])).alias("samples"))


@register("SRC-11", """WITH c AS (SELECT vec_id // 25 i, count(*) * 64 n FROM embeddings GROUP BY 1)
 SELECT 'clip' || i AS name, CASE WHEN i % 4 = 1 AND 44 + 2 * n > 1000 THEN 'error' ELSE 'ok' END state, CASE WHEN i % 4 = 1 AND 44 + 2 * n > 1000 THEN 'cut short' END error, 8000 samplerate, 1 channels, 16 bits, n frames, n / 8000 duration_sec, true bounded FROM c
 UNION ALL SELECT 'note' || n_nationkey, 'error', 'not a WAV file', NULL, NULL, NULL, NULL, NULL, true FROM nation UNION ALL SELECT 'gone' || r_regionkey, 'missing', NULL, NULL, NULL, NULL, NULL, NULL, true FROM region""")  # fmt: skip
def headers(spark, d):
    """Sound files, some cut short, notes and files that aren't there: what the first bytes of each say."""
    folder = new_folder(spark)
    sound = media.encode_wav(_recordings(spark, d).select(F.concat(F.lit("clip"), "clip_id").alias("path"), "samples"), 8000)
    cut = F.when(F.substring("path", 5, 20).cast("long") % 4 == 1, F.substring("content", 1, 1000)).otherwise(F.col("content"))
    notes = table(spark, d, "nation").select(F.concat(F.lit("note"), "n_nationkey").alias("name"), F.encode("n_name", "UTF-8").alias("content"))
    files = ranged.write_files(sound.select(F.col("path").alias("name"), cut.alias("content")).unionByName(notes), folder)
    gone = table(spark, d, "region").select(F.concat(F.lit(f"{folder}/name=gone"), "r_regionkey", F.lit("/none.wav")).alias("path"))
    found = ranged.wav_headers(files.select("path").unionByName(gone))
    return found.select(ranged.name_of("path").alias("name"), "state", "error", "samplerate", "channels", "bits", "frames", "duration_sec", (F.col("bytes_read") <= 64).alias("bounded"))


@register("SRC-10", "SELECT page_id // 20 archive, page_id || '.html' AS member, strlen(html)::BIGINT AS size, md5(html) md5 FROM pages")
def archives(spark, d):
    """Twenty pages to an archive: the directories, and each member read on its own."""
    pages = table(spark, d, "pages").select(F.floor(F.col("page_id") / 20).alias("archive"), F.concat(F.col("page_id"), F.lit(".html")).alias("member"), F.encode("html", "UTF-8").alias("content"))
    files = ranged.write_files(media.zip_files(pages, "archive").select(F.col("archive").cast("string").alias("name"), "content"), new_folder(spark))
    listed = ranged.zip_listing(files)
    read = ranged.zip_members(listed.where(F.col("member").endswith(".html"))).select("path", "member", F.md5("content").alias("md5"))
    return listed.join(read, ["path", "member"]).select(ranged.name_of("path").cast("long").alias("archive"), "member", "size", "md5")


_SHAPES = """CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '"  ' || event_type || ' "' WHEN 2 THEN '[{"name": "' || event_type || '"}, {"title": " t' || user_id || '"}, " x ", 5, "", {"name": "", "title": "u"}]'
 WHEN 3 THEN '{"title": "' || event_type || '"}' WHEN 4 THEN 'null' WHEN 5 THEN 'not json' ELSE CAST(user_id AS STRING) END"""
_ONE = """CASE json_type({x}) WHEN 'OBJECT' THEN coalesce(nullif(trim({x}->>'$.name'), ''), nullif(trim({x}->>'$.title'), ''), replace({x}::VARCHAR, ' ', '')) WHEN 'NULL' THEN NULL ELSE nullif(trim({x}->>'$'), '') END"""


@register("JSN-4", f"""WITH s AS (SELECT event_id, {_SHAPES} AS shape FROM events), j AS (SELECT event_id, CASE WHEN json_valid(shape) THEN shape::JSON END j FROM s)
 SELECT event_id, CASE WHEN json_type(j) = 'ARRAY' THEN nullif(array_to_string(list_filter(list_transform(from_json(j, '["json"]'), lambda x: {_ONE.format(x='x')}), lambda x: x IS NOT NULL), '; '), '') ELSE {_ONE.format(x='j')} END AS text FROM j""")  # fmt: skip
def any_shape(spark, d):
    """Scalars, lists, objects, null and what isn't JSON, each as one string."""
    return table(spark, d, "events").select("event_id", J.text_of(J.parse(F.expr(_SHAPES))).alias("text"))


_ITEM = """CASE turn % 6 WHEN 0 THEN '{"artist": {"name": " a' || turn || ' ", "title": "no"}, "name": "no"}' WHEN 1 THEN '{"artist": {"title": "b' || turn || '"}, "mbid": "k' || turn || '"}' WHEN 2 THEN '{"name": "", "title": "c' || turn || '", "mbid": " m' || turn || '"}'
 WHEN 3 THEN '{"common_name": "d' || turn || '"}' WHEN 4 THEN '{"mbid": "e' || turn || '"}' ELSE '"f' || turn || ' "' END"""
_NAMED = "CASE turn % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' WHEN 4 THEN 'e' ELSE 'f' END || turn"


@register("JSN-2 JSN-3 STR-16", f"""SELECT conv_id, string_agg({_NAMED}, '; ' ORDER BY turn) AS names, coalesce(string_agg(CASE turn % 6 WHEN 1 THEN 'k' || turn WHEN 2 THEN 'm' || turn WHEN 4 THEN 'e' || turn END, ',' ORDER BY turn), '') ids FROM conversations GROUP BY 1""")
def names_and_ids(spark, d):
    """Names of a list's items by six priorities, and their ids, from JSON text."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_ITEM).alias("item"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "item"))).alias("l"))
    value = J.parse(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["item"]), ", "), F.lit("]")))
    return lists.select("conv_id", J.names(value).alias("names"), F.array_join(J.ids(value), ",").alias("ids"))


_COS = "list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))"


def _codes(spec: str, out: str) -> str:
    return f"""{out} AS (SELECT clip_id, frame, list(x ORDER BY g) e FROM (SELECT clip_id, frame, g, ln(1 + sum(v)) x FROM {spec} JOIN band USING (bin) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@register("RET-15", f"""WITH {L._SAMPLES}, {L._spectra()}, {L._BANDS}, nsmp AS (SELECT a.clip_id, a.pos, a.x + 0.05::DOUBLE * coalesce(b.x, 0) x FROM smp a LEFT JOIN smp b ON b.clip_id = a.clip_id AND b.pos = a.pos + 1),
 {L._spectra('nsmp', 'nspec')}, {_codes('nspec', 'near')}, f AS (SELECT c.clip_id, c.frame, c.e, n.e ne, s.n FROM code c JOIN near n USING (clip_id, frame) JOIN size s USING (clip_id)),
 o AS (SELECT avg({_COS.format(a='f.e', b='f.ne')}) same_cos, avg({_COS.format(a='f.e', b='g.ne')}) other_cos, count(*) n FROM f LEFT JOIN f g ON g.clip_id = f.clip_id AND g.frame = (f.frame - f.n // 2 + f.n) % f.n AND f.n > 1)
 SELECT n, 1::DOUBLE stored_cos, 0::DOUBLE determinism, round(same_cos, 4) same_cos, round(other_cos, 4) other_cos, true stored_ok, true deterministic, same_cos - other_cos > 0.02 discriminates, same_cos - other_cos > 0.02 passed FROM o""")  # fmt: skip
def encoder_gates(spark, d):
    """Vectors of a written index against two new runs, and against samples with an echo."""
    folder, signal = new_folder(spark), L.chunks(spark, d)
    vector_index.build(signal, folder)
    stored = vector_index.open_index(spark, folder).withColumnRenamed("ref_id", "clip_id")
    fresh, again, altered = (vector_index.encode_segments(s) for s in (signal, signal, _echo(signal)))
    return gates.encoder_gates(stored, fresh, again, altered, 0.02).withColumns({c: F.round(c, 4) for c in ("stored_cos", "determinism", "same_cos", "other_cos")})


def _echo(signal):
    """Each sample with a twentieth of the next one."""
    nxt = signal.select("clip_id", (F.col("at") - 64).alias("at"), F.get("samples", F.lit(0)).alias("follows"))
    rows = signal.join(nxt, ["clip_id", "at"], "left")
    shifted = F.concat(F.slice("samples", 2, 63), F.array(F.coalesce("follows", F.lit(0.0))))
    return rows.select("clip_id", "at", F.zip_with("samples", shifted, lambda x, y: x + 0.05 * y).alias("samples"))


_WORKS = "SELECT DISTINCT vec_id // 25 r, 'works' kind, (vec_id // 25) // 2 AS key FROM embeddings UNION ALL SELECT DISTINCT vec_id // 25, 'titles', (vec_id // 25) % 13 FROM embeddings WHERE (vec_id // 25) % 6 = 5"


@register("CAL-5", with_search(3, 0.8).replace("WITH seg", f"""WITH RECURSIVE keyed AS ({_WORKS}), link AS (SELECT DISTINCT a.r a, b.r b FROM keyed a JOIN keyed b USING (kind, key)),
 reach AS (SELECT r node, r seen FROM (SELECT DISTINCT vec_id // 25 r FROM embeddings) UNION SELECT node, b FROM reach JOIN link ON seen = a),
 comp AS (SELECT node r, min(seen) component, ('0x' || substr(sha256('20260511:' || min(seen)), 1, 13))::BIGINT < 1125899906842624 held_out FROM reach GROUP BY 1), lib AS (SELECT DISTINCT r FROM comp WHERE NOT held_out), seg""", 1)
 .replace("FROM clip, seg)", "FROM clip, (SELECT seg.* FROM seg JOIN lib ON r = seg.ref_id) seg)").replace("cand + q_off GROUP BY 1, 2)", "cand + q_off JOIN lib ON lib.r = seg.ref_id GROUP BY 1, 2 HAVING count(*) = 3)")
 + """, best AS (SELECT query_id, score, cand // 25 ref FROM ranked WHERE rank = 1), q AS (SELECT comp.*, score, ref FROM comp JOIN (SELECT DISTINCT query_id FROM clip) ON query_id = r LEFT JOIN best USING (query_id)),
 neg AS (SELECT score FROM q WHERE held_out AND score IS NOT NULL), t AS (SELECT min(score) + 1e-6 th FROM (SELECT score, row_number() OVER (ORDER BY score DESC) n FROM neg) WHERE n <= greatest(1, floor(0.05 * (SELECT count(*) FROM neg))))
 SELECT r query_id, component, held_out, ref predicted_ref_id, score, score >= th accepted FROM q, t""")  # fmt: skip
def open_set_probes(spark, d):
    """Whole components of recordings that share a work or title are held out of the library, and all clips are searched in the rest."""
    lib = segments(spark, d)
    refs = lib.select("ref_id").distinct()
    keyed = refs.select("ref_id", F.array(F.floor(F.col("ref_id") / 2)).alias("works"), F.when(F.col("ref_id") % 6 == 5, F.array(F.col("ref_id") % 13)).otherwise(F.array().cast("array<bigint>")).alias("titles"))
    found = components.components(refs, components.star_links(keyed, "ref_id", "works", "titles"), new_folder(spark), "ref_id")
    split = components.held_out(found, 0.25)
    split.write.parquet(to := new_folder(spark))
    split = spark.read.parquet(to)
    rest = lib.join(split.where("not held_out").select("ref_id"), "ref_id")
    q = clips(spark, d, 3, 0.8)
    lengths = q.groupBy("query_id").agg(F.count("*").alias("length"))
    cands = R.candidates(R.knn(q, rest, 20), lengths, lib.count())
    best = R.top_k(R.rescore(cands, q, rest, whole=True), 1).select("query_id", "score", F.floor(F.col("cand") / 25).alias("predicted_ref_id"))
    rows = split.join(lengths.select("query_id"), F.col("ref_id") == F.col("query_id")).join(best, "query_id", "left").select("query_id", "component", "held_out", "predicted_ref_id", "score")
    rows.write.parquet(to := new_folder(spark))
    rows = spark.read.parquet(to)
    chosen = C.threshold(rows.where("held_out").select("score"))
    return rows.crossJoin(F.broadcast(chosen.select("threshold"))).select(*rows.columns, (F.col("score") >= F.col("threshold")).alias("accepted"))  # one row


@register("AUD-5", """WITH w AS (SELECT lang, n_chars % 50 work, count(*) n FROM documents GROUP BY 1, 2),
 s AS (SELECT lang, count_if(n >= 2) works_2, count_if(n >= 3) works_3, count(*) n_works FROM w GROUP BY 1), t AS (SELECT lang, string_agg(work || ':' || n, ' ' ORDER BY n DESC, work) top FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, work) k FROM w QUALIFY k <= 3) GROUP BY 1)
 SELECT lang corpus, count(*) n_tracks, count_if(trim(text) <> '') n_titled, count(DISTINCT source) n_artists, n_works, works_2, works_3, top, sum(len(string_split(text, chr(10))))::BIGINT n_sections, round(sum(n_chars) / 3600, 6) AS hours, min(n_chars) shortest, max(n_chars) longest
 FROM documents JOIN s USING (lang) JOIN t USING (lang) GROUP BY lang, n_works, works_2, works_3, top""")  # fmt: skip
def inspected(spark, d):
    """Tracks, artists, works with several performances, sections and lengths of each corpus."""
    rows = table(spark, d, "documents").withColumn("work", F.col("n_chars") % 50)
    works = rows.groupBy("lang", "work").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), "work")
    counted = works.groupBy("lang").agg(F.count("*").alias("n_works"), F.count_if(F.col("n") >= 2).alias("works_2"), F.count_if(F.col("n") >= 3).alias("works_3"), F.slice(F.array_sort(F.collect_list(order)), 1, 3).alias("top"))
    counted = counted.withColumn("top", F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["work"], -x["n"])), " "))
    tracks = rows.groupBy("lang").agg(
        F.count("*").alias("n_tracks"), F.count_if(F.trim("text") != "").alias("n_titled"), F.countDistinct("source").alias("n_artists"), F.sum(F.size(F.split("text", "\n"))).alias("n_sections"),
        F.round(F.sum("n_chars") / 3600, 6).alias("hours"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"),
    )
    return tracks.join(counted, "lang").withColumnRenamed("lang", "corpus")


@register("AUD-8", "WITH " + L._GRAMS.split(",\n k AS")[0] + """, n AS (SELECT ref_id, count(*) n FROM lib GROUP BY 1), r AS (SELECT doc_id ref_id, lang corpus, n, n / (n_chars / 60) rate FROM documents JOIN n ON ref_id = doc_id),
 m AS (SELECT avg(n) mean, stddev_samp(n) std, quantile_cont(rate, 0.05) cutoff FROM r)
 SELECT 'no hashes' kind, doc_id::VARCHAR AS name, NULL::DOUBLE AS "value" FROM documents LEFT JOIN n ON ref_id = doc_id WHERE n IS NULL UNION ALL SELECT 'low rate', ref_id::VARCHAR, round(rate, 6) FROM r, m WHERE rate < cutoff
 UNION ALL SELECT 'far count', ref_id::VARCHAR, n::DOUBLE FROM r, m WHERE abs(n - mean) > 3 * std UNION ALL SELECT 'corpus', corpus, count(*)::DOUBLE FROM r GROUP BY corpus
 UNION ALL SELECT 'count', unnest(['min', 'median', 'mean', 'max', 'total']), unnest([min(n), quantile_cont(n, 0.5), round(avg(n), 6), max(n), sum(n)])::DOUBLE FROM r""")  # fmt: skip
def anomalies(spark, d):
    """What is odd about stored recordings: none or few hashes for their length, counts far from the mean; and the distribution."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), "text", "lang", "n_chars", F.md5("text").alias("source_md5"), F.col("n_chars").cast("double").alias("duration_sec"))
    store = L.text_store(spark, docs)
    hash_store.insert(store, docs, R.word_hashes(docs, "ref_id"))
    rows = store.songs().join(docs.select("ref_id", "lang", (F.col("n_chars") / 60).alias("minutes")), "ref_id").select("ref_id", F.col("lang").alias("corpus"), F.col("n_hashes").alias("n"), (F.col("n_hashes") / F.col("minutes")).alias("rate"))
    (cutoff,), (median,) = quantiles.quantiles(rows, "rate", 0.05), quantiles.quantiles(rows, "n", 0.5)
    mean, std = rows.agg(F.avg("n"), F.stddev_samp("n")).first()
    number = lambda x: F.lit(x).cast("double")
    kinds = [
        store.failures().select(F.lit("no hashes").alias("kind"), F.col("ref_id").cast("string").alias("name"), number(None).alias("value")),
        rows.where(F.col("rate") < number(cutoff)).select(F.lit("low rate"), F.col("ref_id").cast("string"), F.round("rate", 6)),
        rows.where(F.abs(F.col("n") - number(mean)) > 3 * number(std)).select(F.lit("far count"), F.col("ref_id").cast("string"), F.col("n").cast("double")),
        rows.groupBy("corpus").count().select(F.lit("corpus"), "corpus", F.col("count").cast("double")),
        rows.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean")).select(
            F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (number(median) if k == "median" else F.col(k).cast("double")).alias("value")) for k in ("min", "median", "mean", "max", "total")])).alias("x")
        ).select(F.lit("count"), "x.name", "x.value"),
    ]
    out = kinds[0]
    for part in kinds[1:]:
        out = out.union(part)
    return out


def _event_files(spark, d, parts=4):
    """Events in files by time, a tenth of each one file late, and at last a row for each user that ends the stream."""
    folder, e = new_folder(spark), table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    first, last = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - first) * parts / (last - first + 1)) + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0)
    e.withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/cut")
    for i in range(parts + 1):
        spark.read.schema(e.schema).parquet(f"{folder}/cut/part={i}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    end = e.select("user_id").distinct().select("user_id", F.lit(-1).cast("bigint").alias("event_id"), F.timestamp_micros(F.lit(last + 100 * 86_400_000_000)).alias("ts"), F.lit("end").alias("event_type"), F.lit(None).cast("double").alias("value"))
    return folder, e, end


#: Events of the users that share a state, about.
_GROUP_EVENTS = 20_000


@register("STM-1", """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) carried
 FROM (SELECT *, count_if(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) g FROM events)""")  # fmt: skip
def carried_stream(spark, d):
    """A stateful stream over files that come out of order: the last click's value, forgotten at an error."""
    folder, e, end = _event_files(spark, d)
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = streaming.read_parquet_stream(spark, f"{folder}/in", e.schema)
    groups = max(32, -(-e.count() // _GROUP_EVENTS))  # the count is read from the files' footers
    with state.state_store(spark):
        rows = state.carried(stream, "user_id", "click", "error", "end", "20 days", groups)
        streaming.run_available(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select(F.col("key").alias("user_id"), "event_id", "carried")


@register("STM-3 STM-4", "SELECT count(*) n, round(sum(value), 4) total, max(value) most, count_if(value < 1) failed, 5 AS batches, count(*) written FROM events")
def observed_stream(spark, d):
    """Running totals of a stream's batches, observed while they are written, and the rows that were."""
    folder, e, _ = _event_files(spark, d)
    seen = {"n": F.count(F.lit(1)), "total": F.sum("value"), "most": F.max("value"), "failed": F.count_if(F.col("value") < 1)}
    found = streaming.run_observed(streaming.read_parquet_stream(spark, f"{folder}/in", e.schema), folder, f"{folder}/checkpoint", seen)
    totals = found.agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"), F.max("most").alias("most"), F.sum("failed").alias("failed"), F.count("*").cast("int").alias("batches"))
    return totals.crossJoin(spark.read.parquet(f"{folder}/rows").agg(F.count("*").alias("written")))  # one row each


@register("SNK-14", "SELECT source, count(*) written, count(*) n FROM documents GROUP BY 1")
def counted_writes(spark, d):
    """Written with the number of rows taken on the way, and counted again when read."""
    folder = new_folder(spark)
    n = streaming.write_counted(table(spark, d, "documents").select("doc_id", "source"), folder)
    read = spark.read.parquet(folder)
    return read.groupBy("source").agg(F.count("*").alias("n")).withColumn("written", F.when(F.lit(n["n"]) == F.lit(read.count()), F.col("n")))

