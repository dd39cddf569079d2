"""Paired bootstrap by weights from hashes, and risk against coverage."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A prime: hashes are whole numbers below it.
PRIME = 2**31 - 1
REPLICATES, ROWS = 5000, 512


def poisson_steps() -> list[int]:
    """Hashes from which on a weight of a Poisson distribution with mean 1 is 1, 2, ..."""
    total, out = 0.0, []
    for k in range(13):
        total += math.exp(-1) / math.factorial(k)
        out.append(math.floor(total * PRIME))
    return out


def multipliers(replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``a, b`` of each replicate: the hash of a query is ``(h * a + b) mod PRIME``, independent for any two queries."""
    words = [hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(replicates)]
    a = np.array([int.from_bytes(w[:8]) % (PRIME - 1) + 1 for w in words], np.int64)
    return a, np.array([int.from_bytes(w[8:16]) % PRIME for w in words], np.int64)


def query_hash(id: Column, seed: int) -> Column:
    """A query's whole number below ``PRIME``, from the SHA-256 of seed and id."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), id.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long"), F.lit(PRIME))


def bootstrap_sums(pairs: DataFrame, replicates: int = REPLICATES, seed: int = 20260511) -> DataFrame:
    """``replicate, n, base, other``: sums of weights, and of those of hits, of ``query_id, base_hit, hit``.

    Each query weighs as often in a replicate as if queries were drawn with
    replacement, by its own hash; so sums of parts add up, and one pass over the
    rows makes all replicates.  Null hits are misses, a null id leaves its row out.
    """
    one = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    rows = pairs.where("query_id is not null").select(query_hash(F.col("query_id"), seed).alias("h"), one("base_hit").alias("x"), one("hit").alias("y"))
    a, b = multipliers(replicates, seed)
    steps = np.array(poisson_steps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, replicates), np.int64)
        for batch in batches:
            h, x, y = (np.asarray(batch.column(i)).astype(np.int64) for i in range(3))
            for i in range(0, len(h), ROWS):
                weight = np.searchsorted(steps, (h[i : i + ROWS, None] * a + b) % PRIME, side="right")
                sums += np.stack([weight.sum(axis=0), x[i : i + ROWS] @ weight, y[i : i + ROWS] @ weight])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *map(pa.array, sums)], ["replicate", "n", "base", "other"])

    found = rows.mapInArrow(run, "replicate long, n long, base long, other long")
    return found.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n", "base", "other")])


def paired_bootstrap(pairs: DataFrame, replicates: int = REPLICATES, level: float = 0.95, seed: int = 20260511) -> DataFrame:
    """One row: ``delta`` of the hit rates as they are, and the bounds of its percentile interval over all replicates."""
    sums = bootstrap_sums(pairs, replicates, seed).where("n > 0").select(((F.col("other") - F.col("base")) / F.col("n")).alias("d"))
    edge = (1 - level) / 2
    bounds = sums.agg(F.count("*").alias("replicates"), F.percentile("d", F.array(F.lit(edge), F.lit(1 - edge))).alias("q"))  # a row for each replicate
    known = pairs.where("query_id is not null")
    point = known.agg(F.count("*").alias("n"), (F.avg(F.coalesce(F.col("hit").cast("int"), F.lit(0))) - F.avg(F.coalesce(F.col("base_hit").cast("int"), F.lit(0)))).alias("delta"))
    return point.crossJoin(F.broadcast(bounds)).select("n", "delta", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "replicates")  # one row each


def risk_coverage(answers: DataFrame, steps: int = 100) -> DataFrame:
    """``threshold, answered, coverage, risk`` at ``i / steps``: of all queries, those with a score of at least that, and the share of wrong ones among these.

    ``answers``: ``score, hit`` of each query; a query without a score is never answered.
    Scores are counted by step first, so no score meets every threshold.
    """
    last = F.least(F.lit(steps), F.floor(F.round(F.col("score") * steps, 6))).cast("int")
    counts = answers.where("score >= 0").groupBy(last.alias("i")).agg(F.count("*").alias("k"), F.count_if(~F.coalesce("hit", F.lit(False))).alias("wrong"))
    total = answers.agg(F.count("*").alias("total"))
    above = Window.orderBy(F.desc("i"))  # steps + 1 rows
    grid = answers.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left").na.fill(0)
    grid = grid.select("i", F.sum("k").over(above).alias("answered"), F.sum("wrong").over(above).alias("wrong")).crossJoin(F.broadcast(total))
    return grid.select((F.col("i") / steps).alias("threshold"), "answered", (F.col("answered") / F.greatest("total", F.lit(1))).alias("coverage"), F.when(F.col("answered") > 0, F.col("wrong") / F.col("answered")).alias("risk"))
