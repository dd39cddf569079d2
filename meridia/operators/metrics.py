"""Scores of ranked answers against a manifest of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson
from .quantiles import quantiles


def _correct() -> Column:
    """A missing prediction is a miss."""
    return F.coalesce(F.col("predicted_ref_id") == F.col("ref_id"), F.lit(False))


def per_query(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per query of the manifest: first correct rank, whether any answer exists, its top answer."""
    answers = results.where("rank >= 1").select("query_id", "rank", "predicted_ref_id", "ref_start", "query_start")
    joined = answers.join(manifest.select("query_id", "ref_id"), "query_id")
    summed = joined.groupBy("query_id").agg(
        F.min(F.when(_correct(), F.col("rank"))).alias("first_rank"),
        F.max(F.when(F.col("rank") == 1, F.struct((F.col("ref_start") - F.col("query_start")).alias("at")))).alias("top"),
    )
    out = manifest.join(summed.withColumn("answered", F.lit(True)), "query_id", "left")
    error = F.when(F.col("first_rank") == 1, F.abs(F.col("top")["at"] - F.col("offset_sec")))
    return out.withColumn("answered", F.coalesce("answered", F.lit(False))).withColumn("align_error", error).drop("top")


def hit(k: int) -> Column:
    return F.coalesce(F.col("first_rank") <= k, F.lit(False))


def scorecard(results: DataFrame, manifest: DataFrame, *groups: str) -> DataFrame:
    """HR@1/5/10, MRR@10, Wilson bounds of HR@1, no-match share: over all and by each group, in one pass.

    Rows carry ``grouping`` (the group's column, or ``all``) and ``value``.
    """
    table = per_query(results, manifest)
    table = table.select("query_id", "first_rank", "answered", F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), (F.lit("all") if g == "all" else F.col(g).cast("string")).alias("value")) for g in ("all", *groups)])).alias("g")).select("*", "g.*")
    n = F.count("*")
    out = table.groupBy("grouping", "value").agg(
        n.alias("n"), F.count_if(hit(1)).alias("hits"), (F.count_if(hit(1)) / n).alias("hr_1"), (F.count_if(hit(5)) / n).alias("hr_5"), (F.count_if(hit(10)) / n).alias("hr_10"),
        (F.sum(F.when(hit(10), 1 / F.col("first_rank")).otherwise(0.0)) / n).alias("mrr_10"), F.count_if(~F.col("answered")).alias("no_match"),
    )
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.withColumn("ci_low", low).withColumn("ci_high", high).withColumn("frac_no_match", F.col("no_match") / F.col("n"))


def alignment(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Median, 95th percentile and maximum alignment error of correct top answers, and counts within bounds."""
    e, n, rows = F.col("align_error"), F.count("*"), per_query(results, manifest)
    median, p95 = (F.lit(q).cast("double") for q in quantiles(rows, "align_error", 0.5, 0.95))
    near = {f"within_{str(b).replace('.', '_')}": F.count_if(e <= b) for b in (0.05, 0.5, 1.0)}
    return rows.agg(F.count("align_error").alias("n_aligned"), median.alias("median"), p95.alias("p95"), F.max(e).alias("max"), *[c.alias(k) for k, c in near.items()], *[(c / n).alias("rate_" + k) for k, c in near.items()])


def percentiles(table: DataFrame, column: str, *shares: float) -> DataFrame:
    """Exact percentiles with linear interpolation, and the maximum."""
    found = quantiles(table, column, *shares)
    return table.agg(F.max(column).alias("max")).select(*[F.lit(q).cast("double").alias(f"p{round(s * 100)}") for s, q in zip(shares, found, strict=True)], "max")


def top_predictions(results: DataFrame, k: int = 10) -> DataFrame:
    """Predictions of each query in rank order, as a list."""
    rows = results.where(F.col("rank").between(1, k)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "predicted_ref_id"))).alias("l"))
    return rows.select("query_id", F.array_join(F.transform("l", lambda x: x["predicted_ref_id"].cast("string")), ",").alias("preds"))
