"""Connected components of shared keys, and splits that keep them whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_links(items: DataFrame, id: str, *keys: str) -> DataFrame:
    """``a, b``: each item linked with the smallest one that holds one of its keys (array columns), not all pairs."""
    parts = [items.select(F.col(id).alias("b"), F.lit(k).alias("kind"), F.explode(F.array_distinct(k)).alias("key")) for k in keys]
    long = reduce(DataFrame.unionByName, parts).where("key is not null")
    least = long.groupBy("kind", "key").agg(F.min("b").alias("a"))
    return long.join(least, ["kind", "key"]).select("a", "b").where("a <> b").distinct()


def components(nodes: DataFrame, links: DataFrame, folder: str, id: str = "id") -> DataFrame:
    """``id, component``: the smallest id that can be reached over links ``a, b``.

    Alternating stars: every node's larger neighbours, and then all its neighbours, are hung on the smallest
    one, until nothing changes.  Rounds grow with the logarithm of the longest path, and
    no round has more links than the one before.  Each round is written to ``folder``.
    """
    spark = links.sparkSession
    edges, n = links.where("a is not null and b is not null and a <> b").select("a", "b"), 0

    def written(table: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        table.write.parquet(f"{folder}/{n}")
        return spark.read.parquet(f"{folder}/{n}")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Of each node's neighbours, the larger ones (or those up to it) point to the least of the node and all of them."""
        seen = edges.select("a", "b").union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b"), F.least("a", "b"))
        seen = seen.toDF("u", "v").distinct()
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = seen.join(least, "u")
        if large:
            return hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(own).where("a <> b").distinct()

    edges, before = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        edges = written(star(written(star(edges, True)), False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    found = edges.groupBy(F.col("a").alias(id)).agg(F.min("b").alias("component"))
    return nodes.select(id).distinct().join(found, id, "left").select(id, F.coalesce("component", F.col(id)).alias("component"))


def held_out(found: DataFrame, share: float, seed: int = 20260511) -> DataFrame:
    """``found`` with ``held_out``: whole components by the hash of seed and component, about a ``share`` of them."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col("component").cast("string")), 256), 1, 13), 16, 10).cast("long")
    return found.withColumn("held_out", bits < F.lit(int(share * 2**52)))


