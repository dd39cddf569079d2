"""Queries of strings, audits, profiles and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import audit as A
from ..operators import sampling as P
from .registry import register, table

_TOK = "list_distinct(list_filter(list_transform(string_split({x}, ';'), lambda t: trim(t)), lambda t: t <> ''))"
_WORKS = "(SELECT p_partkey, upper(split_part(p_name, ' ', 1)) || '; ' || p_name || ' ;; ' || p_name works FROM part)"


def _works(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.concat(F.upper(F.split_part(name, F.lit(" "), F.lit(1))), F.lit("; "), name, F.lit(" ;; "), name).alias("works"))


@register("STR-1", f"SELECT p_partkey, array_to_string(list_sort({_TOK.format(x='works')}), '|') tokens FROM {_WORKS}")
def token_sets(spark, d):
    return _works(spark, d).select("p_partkey", F.array_join(F.array_sort(S.token_set(F.col("works"))), "|").alias("tokens"))


@register("STR-2 STR-4", f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform({_TOK.format(x='works')}, lambda t: lower(t)))), ';') key FROM {_WORKS}")
def keys(spark, d):
    return _works(spark, d).select("p_partkey", S.canonical_key(F.col("works")).alias("key"))


@register("STR-3 STR-19 QRK-3", f"SELECT a.p_partkey, list_has_any(string_split(a.works, ';'), string_split(b.works, ';')) overlap FROM {_WORKS} a JOIN {_WORKS} b ON b.p_partkey = a.p_partkey + 1")
def raw_overlaps(spark, d):
    w = _works(spark, d)
    return w.join(w.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("works").alias("other")), "p_partkey").select("p_partkey", S.raw_overlap(F.col("works"), F.col("other")).alias("overlap"))


#: Section labels as the corpora write them; each text gets one in front.
_LABELS = (
    "Tani Āvartanam", "Ālāp", "Rāgam Ālāpana", "PALLAVI", "Anupallavi", "Caraṇam", "Khyāl", "Kriti", "Kīrtana", "Tarānā", "Bandish", "Thumrī", "Bhajan", "Dādrā", "Tani in Ālāp", "Interlude",
)
_LABELLED = f"(SELECT doc_id, [{', '.join(repr(x) for x in _LABELS)}][1 + doc_id % {len(_LABELS)}] || ' ' || text t FROM documents)"


def _labelled(spark, d):
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("doc_id") % len(_LABELS)).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(label, F.lit(" "), "text").alias("t"))


def _any(column, needles):
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


_CHAIN = " ".join(f"WHEN {_any('f', needles)} THEN '{name}'" for name, needles in S.SECTION_RULES)


@register("STR-6 UDF-1", f"SELECT doc_id, CASE {_CHAIN} END kind FROM (SELECT doc_id, strip_accents(lower(t)) f FROM {_LABELLED})")
def classified(spark, d):
    """The rule chain of section labels over labels and whole texts, without regard to case and accents."""
    return _labelled(spark, d).select("doc_id", S.classify(F.col("t"), S.SECTION_RULES).alias("kind"))


@register("STR-5", "SELECT doc_id, contains(strip_accents(lower(text)), 'uber') \"uber\", contains(strip_accents(lower(text)), 'cion') cion FROM documents")
def folded(spark, d):
    """Whole texts hold a needle, whatever its case and accents."""
    return table(spark, d, "documents").select("doc_id", S.holds(F.col("text"), "uber").alias("uber"), S.holds(F.col("text"), "cion").alias("cion"))


@register("STR-7 UDF-2", f"SELECT doc_id, {', '.join(f'{_any("f", n)} is_{k}' for k, n in S.INSPECTION_RULES)} FROM (SELECT doc_id, lower(coalesce(t, '')) f FROM {_LABELLED})")
def needles(spark, d):
    """The second rule set: lower case only, so accents count."""
    return _labelled(spark, d).select("doc_id", *(found.alias(f"is_{k}") for k, found in S.marks(F.col("t"), S.INSPECTION_RULES).items()))


_DIFFER = f"SELECT kind, is_alaap, is_composed, count(*) n FROM (SELECT CASE {_CHAIN} END kind, {', '.join(f'{_any("g", n)} is_{k}' for k, n in S.INSPECTION_RULES)} FROM (SELECT strip_accents(lower(t)) f, lower(coalesce(t, '')) g FROM {_LABELLED})) GROUP BY ALL"


@register("QRK-20", _DIFFER)
def rule_sets_differ(spark, d):
    """How both rule sets judge the same texts: they have different needles and fold differently."""
    both = _labelled(spark, d).select(S.classify(F.col("t"), S.SECTION_RULES).alias("kind"), *(found.alias(f"is_{k}") for k, found in S.marks(F.col("t"), S.INSPECTION_RULES).items()))
    return both.groupBy("kind", "is_alaap", "is_composed").agg(F.count("*").alias("n"))


@register("STR-10 STR-18", "SELECT o_orderkey, format('ref_t{:04d}_q{:d}', o_custkey, o_orderkey % 5) id, (o_orderkey % 10)::INT || 's' AS label FROM orders")
def composed_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("ref_t%04d_q%d", F.col("o_custkey"), F.col("o_orderkey") % 5).alias("id"), F.concat((F.col("o_orderkey") % 10).cast("string"), F.lit("s")).alias("label"))


@register("STR-11 STR-12 STR-17", "SELECT page_id, split_part(url, '/', 3) host, regexp_extract(url, '([^/]+)/?$', 1) base, replace(url, '/', '_') safe FROM pages")
def names(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.split_part(url, F.lit("/"), F.lit(3)).alias("host"), F.regexp_extract(url, "([^/]+)/?$", 1).alias("base"), F.replace(url, F.lit("/"), F.lit("_")).alias("safe"))


@register("STR-13", "SELECT page_id, CASE WHEN n >= 1048576 THEN round(n / 1048576, 1)::DOUBLE || ' MB' WHEN n >= 1024 THEN round(n / 1024, 1)::DOUBLE || ' KB' ELSE n || ' B' END size FROM (SELECT page_id, length(html) n FROM pages)")
def human(spark, d):
    return table(spark, d, "pages").select("page_id", S.human_bytes(F.length("html").cast("long")).alias("size"))


@register("STR-15", "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] line FROM documents")
def first_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0)).alias("line"))


@register("MTH-6", "SELECT o_orderkey, ('0x' || substr(sha256('20260511:' || o_orderkey), 1, 8))::BIGINT seed FROM orders")
def seeds(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.seed_of(F.concat(F.lit("20260511:"), F.col("o_orderkey").cast("string"))).alias("seed"))


_U = "(('0x' || substr(sha256({x}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@register("SMP-2 MTH-7", f"""WITH r AS (SELECT c_custkey ref_id, 80 + c_custkey % 200 - 40.0::DOUBLE stop FROM customer)
 SELECT format('ref_t{{:04d}}_q{{:d}}', ref_id, i) query_id, ref_id, i::INT i, greatest(30, least(stop, round(30 + (i + 1) / 6 * (stop - 30) + ({_U.format(x="'20260511:' || ref_id || ':' || i")} * 2 - 1) * 2, 3)))::DOUBLE offset_sec FROM r, range(5) t(i) WHERE stop >= 30""")  # fmt: skip
def query_places(spark, d):
    refs = table(spark, d, "customer").select(F.col("c_custkey").alias("ref_id"), (80 + F.col("c_custkey") % 200).cast("double").alias("duration_sec"))
    return P.anchors(refs)


@register("SMP-4 MTH-8", f"""WITH s AS (SELECT user_id track_id, event_id % 1000 * 1.0::DOUBLE a, event_id % 1000 + value b, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 1000 * 1.0::DOUBLE, event_id % 1000 + value) - 1 seq FROM events),
 u AS (SELECT *, least(b, 900) - 10 stop FROM s)
 SELECT track_id, seq, round(greatest(a, least(stop, (a + stop) / 2 + {_U.format(x="'20260511:' || track_id || ':' || seq")} - 0.5)), 3) offset_sec FROM u WHERE stop >= a""")  # fmt: skip
def section_places(spark, d):
    e = table(spark, d, "events")
    s = e.select(F.col("user_id").alias("track_id"), (F.col("event_id") % 1000).cast("double").alias("start_sec"), (F.col("event_id") % 1000 + F.col("value")).alias("end_sec"), F.lit(900.0).alias("track_duration_sec"))
    return P.section_queries(s)


@register("SMP-3", "SELECT c_custkey, l length_sec, l || 's' AS label FROM customer, (SELECT unnest([1, 3, 5, 10]) l)")
def variants(spark, d):
    return P.length_variants(table(spark, d, "customer").select("c_custkey"), [1, 3, 5, 10])


@register("SMP-1", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('20260511:' || doc_id), doc_id) n FROM documents)
 SELECT doc_id, source, n AS round FROM r ORDER BY n, sha256('20260511:' || source), source LIMIT 60""")  # fmt: skip
def stratified(spark, d):
    return P.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", 60)


@register("SMP-6", f"SELECT event_id, floor({_U.format(x='event_id::VARCHAR')} * 91)::BIGINT crop FROM events")
def crops(spark, d):
    return table(spark, d, "events").select("event_id", F.floor(S.uniform(F.col("event_id").cast("string")) * 91).alias("crop"))


@register("SMP-8", """SELECT * FROM (SELECT doc_id id, 'in' kind FROM documents ORDER BY sha256('1:' || doc_id), doc_id LIMIT 12) UNION ALL SELECT * FROM (SELECT item_id, 'out' FROM benchmark ORDER BY sha256('2:' || item_id), item_id LIMIT 8) UNION ALL SELECT -1, 'edge'""")
def mixed_pack(spark, d):
    a = P.uniform_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 12, 1).select(F.col("doc_id").alias("id"), F.lit("in").alias("kind"))
    b = P.uniform_sample(table(spark, d, "benchmark").select("item_id"), "item_id", 8, 2).select(F.col("item_id").alias("id"), F.lit("out").alias("kind"))
    return a.union(b).union(spark.createDataFrame([(-1, "edge")], "id long, kind string"))


_KEYS = "(SELECT p_partkey, 'mbids' kind, p_brand || p_size || p_type AS key FROM part UNION ALL SELECT p_partkey, 'titles', p_name || p_size FROM part)"


def _items(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array(F.concat("p_brand", F.col("p_size").cast("string"), "p_type")).alias("mbids"), F.array(F.concat("p_name", F.col("p_size").cast("string"))).alias("titles"))


@register("JOIN-12 AUD-1 QRK-1", f"SELECT l.p_partkey left_id, r.p_partkey right_id, kind, key FROM {_KEYS} l JOIN {_KEYS} r USING (kind, key) WHERE l.p_partkey <> r.p_partkey")
def twin_pairs(spark, d):
    return A.twins(_items(spark, d), "p_partkey", "mbids", "titles")


@register("AUD-2", f"SELECT p_partkey, p_partkey IN (SELECT l.p_partkey FROM {_KEYS} l JOIN {_KEYS} r USING (kind, key) WHERE l.p_partkey <> r.p_partkey) has_twin FROM part")
def twin_flags(spark, d):
    return A.has_twin(_items(spark, d), "p_partkey", "mbids", "titles")


@register("AUD-3", f"SELECT count(*) n, count_if(t) twins, round(count_if(t) * 100.0 / count(*), 4)::DOUBLE percent FROM (SELECT p_partkey IN (SELECT l.p_partkey FROM {_KEYS} l JOIN {_KEYS} r USING (kind, key) WHERE kind = 'mbids' AND l.p_partkey <> r.p_partkey) t FROM part)")
def twin_counts(spark, d):
    return A.has_twin(_items(spark, d), "p_partkey", "mbids").agg(F.count("*").alias("n"), F.count_if("has_twin").alias("twins"), F.round(F.count_if("has_twin") * 100.0 / F.count("*"), 4).alias("percent"))


@register("JOIN-17 AUD-10", """WITH s AS (SELECT l_orderkey k, l_partkey * 10 + l_linenumber id, (l_partkey % 500)::DOUBLE a, l_partkey % 500 + l_quantity b, l_linenumber % 2 side FROM lineitem)
 SELECT x.k, x.id a_id, y.id b_id, x.a a_start, x.b a_stop, y.a b_start, y.b b_stop FROM s x JOIN s y USING (k) WHERE x.side = 0 AND y.side = 1 AND x.a < y.b AND y.a < x.b""")  # fmt: skip
def overlapping(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 500).cast("double").alias("start"), (F.col("l_partkey") % 500 + F.col("l_quantity")).alias("stop"), (F.col("l_linenumber") % 2).alias("side"))
    return A.overlaps(s.where("side = 0"), s.where("side = 1"), "k", 50.0)


@register("AGG-16", "SELECT w token, count(*) n FROM (SELECT unnest(string_split(p_name, ' ')) w FROM part) GROUP BY 1 ORDER BY n DESC, token LIMIT 10")
def token_counts(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(10)


@register("AGG-17", "SELECT key, count(*) n, string_agg(p_partkey::VARCHAR, '; ' ORDER BY p_partkey) ids FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS key FROM part) GROUP BY 1")
def inverted(spark, d):
    return A.inverted_index(table(spark, d, "part").withColumn("k", F.split("p_name", " ")), "p_partkey", "k")


@register("AGG-18", "SELECT count(value) AS \"count\", round(avg(value), 6) mean, round(stddev_samp(value), 6) std, min(value) AS \"min\", round(quantile_cont(value, 0.25), 9) q25, round(quantile_cont(value, 0.5), 9) q50, round(quantile_cont(value, 0.75), 9) q75, max(value) AS \"max\" FROM events")
def described(spark, d):
    return A.describe(table(spark, d, "events"), "value")


@register("AUD-5.islands", "SELECT user_id, count(*) n_islands, sum(n)::BIGINT n_events FROM (SELECT user_id, island, count(*) n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) island FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def profiled(spark, d):
    return A.islands(table(spark, d, "events"), "user_id", "ts", 21600, "event_id").groupBy("user_id").agg(F.count("*").alias("n_islands"), F.sum("n").alias("n_events"))


@register("AUD-6", "SELECT lang, CASE WHEN count(*) >= 30 THEN 'GO' WHEN count(*) >= 20 THEN 'BORDERLINE' ELSE 'NO-GO' END decision FROM documents GROUP BY 1")
def go_no_go(spark, d):
    n = F.count("*")
    return table(spark, d, "documents").groupBy("lang").agg(F.when(n >= 30, "GO").when(n >= 20, "BORDERLINE").otherwise("NO-GO").alias("decision"))


@register("AUD-7", f"SELECT kind, count_if(n >= 2) ge2, count_if(n >= 3) ge3 FROM (SELECT kind, key, count(*) n FROM {_KEYS} GROUP BY 1, 2) GROUP BY 1")
def cross_versions(spark, d):
    items = _items(spark, d)
    long = items.select("p_partkey", F.lit("mbids").alias("kind"), F.explode("mbids").alias("key")).union(items.select("p_partkey", F.lit("titles"), F.explode("titles")))
    return long.groupBy("kind", "key").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count_if(F.col("n") >= 2).alias("ge2"), F.count_if(F.col("n") >= 3).alias("ge3"))


@register("AUD-9", "SELECT (SELECT count(*) FROM documents) found, (SELECT count(DISTINCT doc_id) FROM documents) expected, (SELECT count(*) FROM documents) = (SELECT count(DISTINCT doc_id) FROM documents) converged")
def row_counts(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("found"), F.countDistinct("doc_id").alias("expected"), (F.count("*") == F.countDistinct("doc_id")).alias("converged"))
