"""Audits of a library: shared works, overlapping clips, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import micros
from .quantiles import quantiles


def twins(items: DataFrame, id: str, *keys: str) -> DataFrame:
    """Ordered pairs of different items that share a key: ``left_id, right_id, kind, key``.

    ``keys`` are array columns, one per kind; an equi-join on ``(kind, key)``.
    """
    long = None
    for kind in keys:
        part = items.select(F.col(id).alias("id"), F.lit(kind).alias("kind"), F.explode(F.array_distinct(kind)).alias("key"))
        long = part if long is None else long.union(part)
    left, right = long.withColumnRenamed("id", "left_id"), long.withColumnRenamed("id", "right_id")
    return left.join(right, ["kind", "key"]).where("left_id <> right_id").select("left_id", "right_id", "kind", "key")


def has_twin(items: DataFrame, id: str, *keys: str) -> DataFrame:
    """``id, has_twin``, from the keys that two items or more hold; pairs are never built."""
    long = None
    for kind in keys:
        part = items.select(id, F.lit(kind).alias("kind"), F.explode(F.array_distinct(kind)).alias("key"))
        long = part if long is None else long.union(part)
    shared = long.groupBy("kind", "key").agg(F.min(id).alias("p"), F.max(id).alias("q")).where("p <> q").select("kind", "key")
    flagged = long.join(shared, ["kind", "key"], "left_semi").select(id).distinct().withColumn("has_twin", F.lit(True))
    return items.select(id).join(flagged, id, "left").na.fill(False, ["has_twin"])


def overlaps(a: DataFrame, b: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of half-open intervals ``(id, key, start, stop)`` on one key that overlap.

    Both sides are cut into bins of ``width`` and joined on key and bin, so a key
    with very many intervals meets bin by bin; a pair counts in the bin where the
    later one starts.
    """
    cut = lambda t, s: t.select(
        key, F.col("id").alias(f"{s}_id"), F.col("start").alias(f"{s}_start"), F.col("stop").alias(f"{s}_stop"),
        F.explode(F.sequence(F.floor(F.col("start") / width), F.greatest(F.floor(F.col("start") / width), F.ceil(F.col("stop") / width) - 1))).alias("bin"),
    )
    pairs = cut(a, "a").join(cut(b, "b"), [key, "bin"]).where("a_start < b_stop and b_start < a_stop")
    return pairs.where(F.col("bin") == F.floor(F.greatest("a_start", "b_start") / width)).drop("bin")


def inverted_index(items: DataFrame, id: str, keys: str) -> DataFrame:
    """``key, n, ids``: which items hold each key."""
    long = items.select(id, F.explode(F.array_distinct(keys)).alias("key"))
    return long.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(id))).cast("array<string>"), "; ").alias("ids"))


def describe(table: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles, max."""
    q25, q50, q75 = (F.lit(q).cast("double") for q in quantiles(table, column, 0.25, 0.5, 0.75))
    return table.agg(
        F.count(column).alias("count"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"), F.min(column).alias("min"),
        q25.alias("q25"), q50.alias("q50"), q75.alias("q75"), F.max(column).alias("max"),
    )


def islands(events: DataFrame, key: str, ts: str, gap_seconds: int, tie: str) -> DataFrame:
    """Gaps and islands: spans of one key's events without a gap of more than so many seconds."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(ts, tie)
    seconds = micros(F.col(ts)) / F.lit(1e6)
    marked = events.withColumn("sec", seconds).withColumn("new", F.coalesce((F.col("sec") - F.lag("sec").over(order) > gap_seconds).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min("sec").alias("start"), F.max("sec").alias("stop"), F.count("*").alias("n"))
