"""Contract queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, quality, stages, token_files, tokens, warc
from .ann import nearest
from .decontaminate import contaminated_words
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .scratch import new_folder
from .source_audit import audit_sources
from .spelling import count_words, group_variants
from .substring_dedup import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    ids = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return bpe.decode(ids, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    # a conversation is a tree without branches: each row replies to the one before it
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("id", F.row_number().over(order).cast("long"))
    chain = rows.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    done = chat.format_conversations(chain, best=1).withColumn("turns", chat.parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page gives a response and, half a minute later, a revisit of a variant of its URL."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("md5"), F.char_length("html").alias("chars"))
    tag = F.when(F.col("page_id") % 5 != 0, F.col("md5"))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 60).alias("ts"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"),
        tag.alias("etag"), F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("day "), F.col("page_id") % 3)).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("chars").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), (F.col("page_id") * 60 + 30).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(F.col("page_id") % 4 == 0, F.lit("other")).when(F.col("page_id") % 3 != 0, F.concat(F.lit("W/"), F.col("md5"))).alias("etag"), F.concat(F.lit("day "), F.col("page_id") % 3).alias("last_modified"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=120"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), (F.col("page_id") * 60 + 30).cast("string")).alias("headers"),
    )
    done = warc.resolve_revisits(response.unionByName(revisit))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return done.select("record_id", "source_id", "outcome", listed.alias("headers"))


def op9_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = tokens.zipf_scores(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    counted = tokens.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), scores, public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_pretokens", "n_tokens")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_perfect_hash_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read from the files by its key; this tokenizer drops white space and case, so words may be encoded apart."""
    folder = new_folder(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        token_files.write_ids(_table(spark, sf_dir, "documents"), folder, file.read(), end_id=1, apart=True)
    found = token_files.read_all(spark, folder)
    return found.select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_table(spark, sf_dir, "documents"))


def op13_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(_table(spark, sf_dir, "documents"), drop_every=31))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, _table(spark, sf_dir, "documents"), sf_dir)


_QUERIES = (
    op1_inverted_multi_index, op2_byte_level_bpe, op3_benchmark_decontamination, op4_chat_formatting, op5_minhash_near_dedup,
    op6_fuzzy_line_dedup, op7_warc_revisits, op8_substring_dedup, op9_unigram_token_counts, op10_quality_classifier,
    op11_perfect_hash_token_files, op12_source_divergence_audit,
    op13_spelling_variant_grouping, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
WITH item AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM item),
size AS (SELECT DISTINCT len(string_split(g, ' ')) k FROM win),
doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
gram AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) i, w FROM doc, size),
met AS (SELECT doc_id, item_id, k, i FROM (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') g FROM gram) JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM met) GROUP BY 1),
items AS (SELECT doc_id, count(*) n, string_agg(item_id, ',' ORDER BY item_id) l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM met) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(hit.n, 0)::BIGINT n_hit, coalesce(items.n, 0)::BIGINT n_items, sha256(coalesce(l, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CONTROL = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)
_OP4 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(t) + length(t) - length(replace(t, chr(92), '')) + {_CONTROL} escaped FROM r)
SELECT conv_id, count(*)::BIGINT n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END)::BIGINT loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY turn, role, t), '')) loss_sha256,
  sum({len(chat.OPEN) + len(chat.BREAK) + len(chat.CLOSE)} + length(role) + escaped)::BIGINT formatted_chars
FROM s GROUP BY conv_id
"""

_OP5 = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM doc),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
c AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id node, doc_id seen FROM documents UNION SELECT reach.node, two.b FROM reach JOIN two ON reach.seen = two.a)
SELECT doc_id, coalesce(n, 0)::BIGINT n_shingles, least component_id, doc_id = least kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node doc_id, min(seen) AS least FROM reach GROUP BY 1) USING (doc_id)
"""

_OP8 = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) i FROM doc)),
least AS (SELECT g, min(doc_id) m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) p FROM win JOIN least USING (g) WHERE doc_id > m),
word AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p FROM doc),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) t, count(*) n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)
"""

_OP7 = r"""
WITH p AS (SELECT page_id, md5(html) m, length(html) n, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') u FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') h,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT string_split(x, '=')[1] IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid', 'gclid'))) q FROM p),
f AS (SELECT *, h || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END key FROM k),
a AS (SELECT r.page_id, r.m, max(s.page_id) src FROM f r LEFT JOIN f s ON r.key = s.key AND s.page_id <= r.page_id AND s.page_id % 11 <> 0 GROUP BY 1, 2),
v AS (SELECT a.page_id, src, s.n,
  CASE WHEN a.page_id % 4 = 0 THEN 'other' WHEN a.page_id % 3 <> 0 THEN a.m END tag, CASE WHEN src % 5 <> 0 THEN s.m END s_tag,
  a.page_id % 3 d, CASE WHEN src % 7 <> 0 THEN src % 3 END s_day FROM a LEFT JOIN f s ON s.page_id = src),
o AS (SELECT *, CASE WHEN src IS NULL THEN 'orphan' WHEN tag IS NOT NULL AND s_tag IS NOT NULL THEN CASE WHEN tag = s_tag THEN 'resolved' ELSE 'changed' END
  WHEN s_day IS NOT NULL THEN CASE WHEN d = s_day THEN 'resolved' ELSE 'changed' END ELSE 'unverified' END outcome FROM v)
SELECT page_id * 2 + 1 record_id, CASE WHEN outcome = 'resolved' THEN src * 2 END source_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120; content-length: ' || n || '; content-type: text/html; date: ' || (page_id * 60 + 30) END headers FROM o
"""

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () id, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
t AS (SELECT id, lang, source, unnest(w) term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) c FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(c), 0)::BIGINT n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (n + 2 * v) p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
w AS (SELECT lang, sum(n)::BIGINT n FROM g GROUP BY 1),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 2)) // (n + 2 * v) q FROM (SELECT lang, term, sum(c)::BIGINT c FROM c GROUP BY 1, 2) JOIN w USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::BIGINT AS "value" FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY "value" DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    sql = {"op3_benchmark_decontamination": _OP3, "op4_chat_formatting": _OP4, "op5_minhash_near_dedup": _OP5, "op7_warc_revisits": _OP7, "op8_substring_dedup": _OP8, "op12_source_divergence_audit": _OP12}
    return {k: v.replace("\\\\", "\\") for k, v in sql.items()}
