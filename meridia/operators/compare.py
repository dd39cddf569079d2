"""Paired comparison of systems on the same queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import BONFERRONI, mcnemar_exact, wilson


def hits_at_1(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """``query_id, hit`` for every query of the manifest; no answer is a miss."""
    top = results.where("rank = 1").select("query_id", "predicted_ref_id")
    return manifest.join(top, "query_id", "left").select(*manifest.columns, F.coalesce(F.col("predicted_ref_id") == F.col("ref_id"), F.lit(False)).alias("hit"))


def discordant(base: DataFrame, other: DataFrame, *cell: str) -> DataFrame:
    """Hits of both, b (base only), c (other only), exact p and the Bonferroni flag, by cell."""
    pairs = base.select("query_id", *cell, F.col("hit").alias("x")).join(other.select("query_id", F.col("hit").alias("y")), "query_id")
    out = pairs.groupBy(*cell).agg(
        F.count("*").alias("n"), F.count_if("x").alias("base_hits"), F.count_if("y").alias("hits"), F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c")
    )
    low, high = wilson(F.col("hits"), F.col("n"))
    out = out.withColumn("ci_low", low).withColumn("ci_high", high).withColumn("delta", F.col("c") - F.col("b")).withColumn("p", mcnemar_exact(F.col("b"), F.col("c")))
    return out.withColumn("significant", F.col("p") < BONFERRONI)


def pool(tables: DataFrame, *cell: str) -> DataFrame:
    """Pooled b and c over seeds, with their p."""
    out = tables.groupBy(*cell).agg(F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    return out.withColumn("p", mcnemar_exact(F.col("b"), F.col("c"))).withColumn("significant", F.col("p") < BONFERRONI)


def miss_table(base: DataFrame, other: DataFrame, answers: DataFrame, same: Column, *cell: str) -> DataFrame:
    """``discordant`` by cell, with the misses of ``other`` and those among them whose answer meets ``same``.

    ``answers``: ``query_id`` and what ``same`` needs of each query's first answer; a query without one misses too.
    """
    kinds = other.join(answers, "query_id", "left").groupBy(*cell).agg(F.count_if(~F.col("hit")).alias("n_miss"), F.count_if(~F.col("hit") & F.coalesce(same, F.lit(False))).alias("n_miss_same"))
    return discordant(base, other, *cell).join(kinds, list(cell))


def pooled_table(base: DataFrame, seeds: DataFrame, *cell: str) -> DataFrame:
    """The table of all seeds against one base, by cell: hits, b and c of each seed, pooled b and c, their p and flags.

    ``seeds``: ``query_id, seed, hit`` and the cell.  ``per_seed`` has a struct ``seed, hits, b, c`` for each, in order.
    """
    pairs = base.select("query_id", *cell, F.col("hit").alias("x")).join(seeds.select("query_id", "seed", F.col("hit").alias("y")), "query_id")
    each = pairs.groupBy(*cell, "seed").agg(
        F.count("*").alias("n"), F.count_if("x").alias("base_hits"), F.count_if("y").alias("hits"), F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c")
    )
    out = each.groupBy(*cell).agg(
        F.max("n").alias("n"), F.count("*").alias("seeds"), F.max("base_hits").alias("base_hits"), F.avg("hits").alias("mean_hits"), F.sum("b").alias("b"), F.sum("c").alias("c"),
        F.array_sort(F.collect_list(F.struct("seed", "hits", "b", "c"))).alias("per_seed"),
    )
    out = out.withColumn("base_hr", F.col("base_hits") / F.col("n")).withColumn("mean_hr", F.col("mean_hits") / F.col("n")).withColumn("delta_pp", (F.col("mean_hr") - F.col("base_hr")) * 100)
    out = out.withColumn("p", mcnemar_exact(F.col("b"), F.col("c")))
    return out.withColumn("significant", F.col("p") < 0.05).withColumn("bonferroni", F.col("p") < BONFERRONI)


def post_mortem(base: DataFrame, seeds: DataFrame, *cell: str) -> DataFrame:
    """What became of each cell's queries over all seeds, against the base: counts, and the base's misses with a twin in the library.

    ``base``: ``query_id, hit, has_twin`` and the cell; ``seeds``: ``query_id, hit``, a row for each seed.
    ``broken``: hits of the base that some seed misses; ``broken_by_all``: that all miss.
    """
    held = seeds.groupBy("query_id").agg(F.bool_and("hit").alias("every"), F.bool_or("hit").alias("some"))
    both = base.select("query_id", *cell, "has_twin", F.col("hit").alias("x")).join(held, "query_id")
    x, every, some = F.col("x"), F.col("every"), F.col("some")
    return both.groupBy(*cell).agg(
        F.count("*").alias("n"), F.count_if(x).alias("base_hits"), F.count_if(~x).alias("base_misses"), F.count_if(~x & F.col("has_twin")).alias("base_twin_misses"),
        F.count_if(~some).alias("persistent_misses"), F.count_if(~every).alias("any_miss"), F.count_if(every).alias("unanimous_hits"), F.count_if(~x & every).alias("fixed"),
        F.count_if(x & ~every).alias("broken"), F.count_if(x & ~some).alias("broken_by_all"),
    )


def across_seeds(hits: DataFrame, base: DataFrame) -> DataFrame:
    """From ``(query_id, seed, hit)`` and the base's hits: persistent, unanimous, fixed and broken queries."""
    seeds = hits.groupBy("query_id").agg(F.bool_and("hit").alias("every"), F.bool_or("hit").alias("some"))
    both = seeds.join(base.select("query_id", F.col("hit").alias("x")), "query_id")
    return both.agg(
        F.count_if(~F.col("some")).alias("persistent_misses"), F.count_if("every").alias("unanimous_hits"), F.count_if(F.col("every") & ~F.col("x")).alias("fixed"),
        F.count_if(~F.col("some") & F.col("x")).alias("broken"), F.count_if(~F.col("every")).alias("any_miss"),
    )


def flips(base: DataFrame, other: DataFrame) -> DataFrame:
    """Each query as fixed, broken, common_hit or common_miss, counted."""
    pairs = base.select("query_id", F.col("hit").alias("x")).join(other.select("query_id", F.col("hit").alias("y")), "query_id")
    kind = F.when(F.col("x") & F.col("y"), "common_hit").when(F.col("x"), "broken").when(F.col("y"), "fixed").otherwise("common_miss")
    return pairs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def best_variant(table: DataFrame, *cell: str) -> DataFrame:
    """The variant of the highest rate in each cell, the smallest on ties."""
    from pyspark.sql import Window

    order = Window.partitionBy(*cell).orderBy(F.desc("hr"), "variant")
    return table.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def verdict(table: DataFrame) -> DataFrame:
    """Adoption: gains or ties in 4 cells, significant in 2, no significant loss; from ``delta, significant``."""
    out = table.agg(F.count_if(F.col("delta") >= 0).alias("n_not_worse"), F.count_if("significant").alias("n_significant"), F.count_if(F.col("significant") & (F.col("delta") < 0)).alias("n_regressions"))
    passed = (F.col("n_not_worse") >= 4) & (F.col("n_significant") >= 2) & (F.col("n_regressions") == 0)
    return out.withColumn("verdict", F.when(passed, "PASS").otherwise("FAIL"))
