"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words become 64-bit hashes, k-grams of them fingerprints.  A fingerprint is kept
where it is the smallest of some ``window - k + 1`` neighbours, so each span of
``window`` words that a document shares with a benchmark item holds a kept
fingerprint at the same place in both.  Kept fingerprints are joined, and each
hit is extended word by word to the windows around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

GRAM = 5
#: Fingerprints of the benchmark are broadcast up to this many, else both sides are shuffled.
BROADCAST_FINGERPRINTS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, A-Z lower-cased; null has none."""
    # lower() is much faster than translate(), and the same for ASCII
    fold = lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(fold(w)))


def _gram(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(hashes, at + j) for j in range(size)])


def _grams(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by position."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(0))), lambda _, i: _gram(hashes, i, size))


def _tagged(size: int):
    return lambda g, i: F.struct(F.lit(size).alias("size"), i.alias("at"), g.alias("gram"))


def _fingerprints(table: DataFrame, window: int, short: list[int]) -> DataFrame:
    """Adds ``prints``: the winnowed k-grams, and all m-grams for each m of ``short``, as (size, at, gram)."""
    span = window - GRAM + 1
    table = table.withColumn("grams", _grams(F.col("hashes"), GRAM))
    grams = F.col("grams")
    table = table.withColumn(
        "least", F.transform(F.slice(grams, 1, F.greatest(F.size(grams) - (span - 1), F.lit(0))), lambda g, i: F.least(g, *[F.get(grams, i + j) for j in range(1, span)]))
    )
    least = F.col("least")
    chosen = F.transform(
        grams,
        lambda g, i: F.when(g == F.greatest(*[F.get(least, i - j) for j in range(span)]), F.struct(F.lit(0).alias("size"), i.alias("at"), g.alias("gram"))),
    )
    parts = [F.filter(chosen, lambda s: s.isNotNull())]
    for m in short:
        parts.append(F.transform(_grams(F.col("hashes"), m), _tagged(m)))
    return table.withColumn("prints", F.concat(*parts)).drop("grams", "least")


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``;
    other columns are ignored.  A-Z are lower-cased; words are runs of digits,
    a-z and non-ASCII characters.  A window is ``window`` consecutive words of
    an item; an item of fewer words, but not none, is one window.

    Returns one row per doc_id: ``doc_id, n_words, hits`` (sorted positions of
    the words inside an occurrence of a window) and ``item_ids`` (sorted, as
    strings, of the items with occurring windows).

    Null or empty texts have no words.  Items with a null id are ignored.
    Repeated items count once; rows that share a doc_id are one document and
    should be alike: if not, it has the words of the longest and the hits of all.
    No documents: an empty table.  An empty benchmark leaves every document without hits.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    docs = docs.select("doc_id", "text")
    bench = materialize(items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), word_hashes(F.col("text")).alias("hashes")).where("size(hashes) > 0"))
    short = sorted(r[0] for r in bench.select(F.size("hashes").alias("m")).where(F.col("m") < window).distinct().collect())
    # explode_outer: for explode() Spark infers a filter on the array and pushes it down with all of its expression inlined
    # an item's words around each fingerprint: of a short item all, else `window - GRAM` to either side
    reach = window - GRAM
    around = F.transform(F.sequence(F.lit(-reach), F.lit(window - 1)), lambda d: F.get(F.col("hashes"), F.col("p.at") + d))
    long_items = _fingerprints(bench.where(F.size("hashes") >= window), window, []).select("item_id", "hashes", F.explode_outer("prints").alias("p")).where("p.gram is not null")
    long_items = long_items.select("item_id", F.col("p.size").alias("size"), F.col("p.gram").alias("gram"), around.alias("theirs"))
    table = long_items
    for m in short:
        own = bench.where(F.size("hashes") == m).select("item_id", F.lit(m).alias("size"), _gram(F.col("hashes"), F.lit(0), m).alias("gram"), F.col("hashes").alias("theirs"))
        table = table.union(own)
    table = materialize(table.distinct())

    # first pass: the fingerprints that the benchmark has too; a last entry of each document holds its number of words
    words = F.array(F.struct(F.lit(-1).alias("size"), F.size("hashes").alias("at"), F.lit(None).cast("long").alias("gram")))
    prints = _fingerprints(docs.select("doc_id", word_hashes(F.col("text")).alias("hashes")), window, short)
    prints = prints.select("doc_id", F.explode_outer(F.concat("prints", words)).alias("p")).select("doc_id", F.col("p.size").alias("size"), F.col("p.at").alias("at"), F.col("p.gram").alias("gram"))
    keys = table.select("size", "gram").distinct().withColumn("known", F.lit(True))
    if table.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS:
        keys, table = F.broadcast(keys), F.broadcast(table)
    met = materialize(prints.join(keys, ["size", "gram"], "left").where("known or size = -1").drop("known"))

    # second pass: words around these fingerprints, compared with the item's
    lists = met.where("size >= 0").groupBy(F.col("doc_id").alias("met_id")).agg(F.collect_set(F.struct("size", "at", "gram")).alias("met"))
    rows = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("met_id"))).select("doc_id", word_hashes(F.col("text")).alias("hashes"), "met")
    around = lambda m: F.transform(F.sequence(F.lit(-reach), F.lit(window - 1)), lambda d: F.get(F.col("hashes"), m["at"] + d))
    rows = rows.select("doc_id", F.explode_outer(F.transform("met", lambda m: F.struct(m["size"].alias("size"), m["at"].alias("at"), m["gram"].alias("gram"), around(m).alias("ours")))).alias("m"))
    rows = rows.select("doc_id", "m.*").join(table, ["size", "gram"])
    at, size = F.col("at"), F.col("size")
    equal = lambda x, y: F.coalesce(x == y, F.lit(False))
    rows = rows.withColumn("same", F.when(size == 0, F.zip_with("ours", "theirs", equal)).otherwise(F.zip_with(F.slice("ours", F.lit(reach + 1), F.greatest(size, F.lit(1))), "theirs", equal)))
    # the fingerprint is at offset s of a window that begins s words before it
    begins = F.filter(F.sequence(F.lit(0), F.lit(reach)), lambda s: F.forall(F.slice("same", F.lit(reach + 1) - s, F.lit(window)), lambda x: x))
    inside = F.array_distinct(F.flatten(F.transform(begins, lambda s: F.sequence(at - s, at - s + (window - 1)))))
    whole = F.when(F.forall("same", lambda x: x), F.sequence(at, at + size - 1))
    rows = rows.select("doc_id", "item_id", F.explode(F.when(size == 0, inside).otherwise(whole)).alias("word"))
    hits = rows.groupBy(F.col("doc_id").alias("hit_id")).agg(F.array_sort(F.collect_set("word")).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))

    every = met.where("size = -1").groupBy("doc_id").agg(F.max("at").cast("long").alias("n_words"))
    out = every.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
