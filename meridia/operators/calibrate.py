"""Acceptance thresholds for queries that may have no answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson
from .quantiles import order_statistics

STEP = 1e-6


def threshold(negatives: DataFrame, fpr: float = 0.05, exact: bool = False) -> DataFrame:
    """One row ``n, threshold``: just above the m-th largest negative score, m = floor(fpr * n) (the largest for m = 0).

    ``exact`` takes the next one down, which uses up the whole budget of false accepts.
    """
    scored = negatives.where("score is not null")
    n = scored.count()
    (chosen,) = order_statistics(scored, "score", [n - max(1, int(fpr * n) + (1 if exact else 0))])
    return negatives.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), (F.lit(chosen).cast("double") + STEP).alias("threshold"))


def rates(positives: DataFrame, negatives: DataFrame, chosen: DataFrame) -> DataFrame:
    """True and false accept rates at the threshold, with Wilson bounds, and whether TPR >= .95 at FPR <= .05."""
    side = lambda t, p: t.crossJoin(F.broadcast(chosen.select("threshold"))).agg(F.count("*").alias(f"n_{p}"), F.count_if(F.col("score") >= F.col("threshold")).alias(f"k_{p}"))  # noqa: E731  chosen: one row
    out = chosen.select("threshold").crossJoin(side(positives, "in")).crossJoin(side(negatives, "out"))
    out = out.withColumn("tpr", F.col("k_in") / F.greatest("n_in", F.lit(1))).withColumn("fpr", F.col("k_out") / F.greatest("n_out", F.lit(1)))
    for p in ("in", "out"):
        low, high = wilson(F.col(f"k_{p}"), F.col(f"n_{p}"))
        out = out.withColumn(f"low_{p}", low).withColumn(f"high_{p}", high)
    return out.withColumn("feasible", (F.col("tpr") >= 0.95) & (F.col("fpr") <= 0.05))


def roc(positives: DataFrame, negatives: DataFrame, steps: int = 1000) -> DataFrame:
    """True and false accept rates at ``i / steps`` for i = 0 .. steps.

    Scores are counted by step first, so no score meets every threshold.
    """
    both = positives.select("score", F.lit(1).alias("y")).union(negatives.select("score", F.lit(0).alias("y")))
    last = F.least(F.lit(steps), F.floor(F.round(F.col("score") * steps, 6)))  # the last threshold it passes
    counts = both.where("score >= 0").groupBy(last.cast("int").alias("i")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    total = both.agg(F.count_if(F.col("y") == 1).alias("np"), F.count_if(F.col("y") == 0).alias("nq"))
    from pyspark.sql import Window

    above = Window.orderBy(F.desc("i"))  # steps + 1 rows
    grid = both.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left").na.fill(0)
    grid = grid.select("i", F.sum("p").over(above).alias("p"), F.sum("q").over(above).alias("q")).crossJoin(F.broadcast(total))
    return grid.select((F.col("i") / steps).alias("threshold"), (F.col("p") / F.greatest("np", F.lit(1))).alias("tpr"), (F.col("q") / F.greatest("nq", F.lit(1))).alias("fpr"))


def histogram(table: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and densities of fixed-width bins; the last bin is closed."""
    at = F.least(F.lit(bins), F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)))
    inside = table.where(F.col(column).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = inside.agg(F.sum("n").alias("total"))
    return inside.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * ((high - low) / bins))).alias("density"))


def ladder(score, high: float, default: float):
    """HIGH, MATCH or NO_MATCH; a missing score is REJECTED."""
    return F.when(score.isNull(), "REJECTED").when(score >= high, "HIGH").when(score >= default, "MATCH").otherwise("NO_MATCH")
