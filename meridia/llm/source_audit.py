"""How the sources of each language differ in their words, by exact whole-number divergences.

A term's occurrences in the sources of its language are a sparse vector of
counts.  Terms of equal vectors are one class: every pair of sources is evaluated
once for each class and multiplied by the number of its terms.  Within a class only
pairs of sources that both have it are looked at; where one source or both have a
count of zero, the value depends on the other's count alone and is taken from
the histogram of counts of each source.  So work follows what occurs, not terms times
pairs of sources, and all sums are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bound_batches, materialize

#: Shares are whole numbers out of so many.
UNIT = 1_000_000_000
#: Entries of a task's table of counts; beyond, it hands them on and begins anew.
HELD = 250_000
#: Bytes of UTF-8 text to letters in lower case (A to Z only); all other ASCII separates terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` from ``lang, source, text``: occurrences and documents, in parts to be added up."""
    bound_batches(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in seen.items():
                size = len(n)
                cells = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield from pa.table(cells, names=names).to_batches(50_000)
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().translate(_FOLD).split()
                if words:
                    n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                    n.update(words)
                    docs.update(set(words))
            if sum(len(n) for n, _ in seen.values()) > HELD:
                yield from out()
        yield from out()

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, terms: Column, smoothing: int) -> Column:
    """``1 + floor(UNIT * (count + smoothing) / (total + smoothing * terms))``, in decimals, which don't overflow."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (wide(count) + smoothing), wide(total + smoothing * terms))


def _apart(p: Column, q: Column) -> Column:
    """``floor((p - q)² / (p + q))``; shares are at most UNIT + 1, so it fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit_sources(docs: DataFrame, min_docs: int = 10, smoothing: int = 2, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` over ``docs`` (``lang, source, text``; null is '').

    Terms are runs of letters and non-ASCII characters, A to Z in lower case; each language keeps those
    in ``min_docs`` of its documents or more.  Shares are smoothed and scaled to ``UNIT``.

    * Part ``pair``: each other source of the language with the sum over all kept
      terms of ``floor((p - q)² / (p + q))`` (0 without terms), all ranks.
    * Part ``term``: each kept term that the source has, and more often than the
      whole language, with the same value against the language, the ``top`` first.

    Ranks are by value, largest first, then by item.  Sources without any term take
    part; an empty table gives no row; repeated documents count each time.
    """
    rows = docs.select("lang", "source", "text")
    groups = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    # one shuffle: sources of a term meet where the term is
    counts = count_terms(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    vectors = materialize(vectors.where(F.col("docs") >= min_docs).select("lang", "term", "vector"))
    classes = materialize(vectors.groupBy("lang", "vector").agg(F.count("*").alias("terms"), F.min("term").alias("name")))  # named by the smallest term

    # of each source and language: occurrences and number of kept terms, and the share of a count of zero
    kept = classes.groupBy("lang").agg(F.sum("terms").alias("kept"))
    sums = classes.select("lang", "terms", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("x.n") * F.col("terms")).alias("total"))
    stats = groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept"])
    stats = stats.withColumn("whole", F.sum("total").over(Window.partitionBy("lang")))
    stats = materialize(stats.withColumn("zero", F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"), smoothing))))

    cells = classes.select("lang", "name", "terms", F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("all"), F.explode("vector").alias("x")).select("lang", "name", "terms", "all", "x.*")
    cells = cells.join(stats, ["lang", "source"]).select(
        "lang", "source", "name", "terms", "zero", _share(F.col("n"), F.col("total"), F.col("kept"), smoothing).alias("p"), _share(F.col("all"), F.col("whole"), F.col("kept"), smoothing).alias("q")
    )
    cells = materialize(cells)
    return _pairs(cells, stats).unionByName(_terms(cells, classes, vectors, top))


def _pairs(cells: DataFrame, stats: DataFrame) -> DataFrame:
    other = stats.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_2"))
    both_zero = _apart(F.col("zero"), F.col("zero_2"))
    # as if no source had any term
    none = stats.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("kept") * both_zero, F.lit(0)).alias("value"))
    # as if no other source had it: by the counts that a source has
    counts = cells.groupBy("lang", "source", "zero", "p").agg(F.sum("terms").alias("terms"))
    one = counts.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (_apart(F.col("p"), F.col("zero_2")) - both_zero)).alias("value"))
    # what is left where both have it, once for each class
    right = cells.select("lang", "name", F.col("source").alias("item"), F.col("zero").alias("zero_2"), F.col("p").alias("p_2"))
    rest = _apart(F.col("p"), F.col("p_2")) - _apart(F.col("p"), F.col("zero_2")) - _apart(F.col("zero"), F.col("p_2")) + both_zero
    two = cells.join(right, ["lang", "name"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * rest).alias("value"))
    turned = [t.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value") for t in (one, two)]
    out = none
    for part in (one, two, *turned):
        out = out.unionByName(part)
    out = out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return out.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(cells: DataFrame, classes: DataFrame, vectors: DataFrame, top: int) -> DataFrame:
    # the first terms of a source are among the first classes, by the smallest term: each class has one at least
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "name")
    chosen = cells.where("p > q").select("lang", "source", "name", _apart(F.col("p"), F.col("q")).alias("value"))
    chosen = chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top).drop("place")
    wanted = classes.select("lang", "name", "vector").join(chosen.select("lang", "name").distinct(), ["lang", "name"])
    inside = Window.partitionBy("lang", "name").orderBy("term")
    members = vectors.join(wanted, ["lang", "vector"]).select("lang", "name", "term")
    members = members.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= top).drop("place")
    last = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = chosen.join(members, ["lang", "name"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
