"""What a system for matching is: queries and a library in, ranked rows of one schema out; and a check that it keeps to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that every system gives; others may follow.
COLUMNS = ("query_id", "rank", "predicted_ref_id", "score", "ref_start")

#: ``() -> results``: a system with its queries and library at hand.
Matcher = Callable[[], DataFrame]


class BrokenContract(ValueError):
    """A system's rows aren't ranked answers."""


def faults(found: DataFrame, queries: DataFrame) -> dict[str, int]:
    """Numbers of rows or queries against the contract, where there are any.

    Each query of ``queries`` (``query_id``) has either one row of rank 0 without an answer, or answers of
    ranks 1 to n, each once, whose scores don't rise.  No other query has rows.
    """
    rows = found.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("ranks"), F.count_if(F.col("rank").isNull()).alias("no_rank"),
        F.count_if((F.col("rank") == 0) != F.col("predicted_ref_id").isNull()).alias("odd"),
        F.array_sort(F.collect_list(F.struct("rank", (-F.col("score")).alias("s")))).alias("l"),
    )
    rows = rows.withColumn("rises", ~F.col("l.s").eqNullSafe(F.array_sort("l.s")))
    joined = rows.withColumn("given", F.lit(True)).join(queries.select("query_id").distinct().withColumn("asked", F.lit(True)), "query_id", "full")
    none = (F.col("n") == 1) & (F.col("low") == 0)
    checks = {
        "queries without a row": F.col("given").isNull(),
        "unknown queries": F.col("asked").isNull(),
        "ranks missing or repeated": (F.col("no_rank") > 0) | ~(none | ((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("ranks") == F.col("n")))),
        "answers of rank 0, or ranks without one": F.col("odd") > 0,
        "scores that rise": F.col("rises") & ~none,
    }
    row = joined.agg(*[F.count_if(c).alias(k) for k, c in checks.items()]).first()
    return {k: row[k] for k in checks if row[k]}


def run(systems: dict[str, Matcher], queries: DataFrame) -> DataFrame:
    """Rows of all systems with their name in ``system``, once each has passed the contract."""
    out = None
    for name, match in systems.items():
        found = match()
        missing = [c for c in COLUMNS if c not in found.columns]
        if missing:
            raise BrokenContract(f"{name} lacks {', '.join(missing)}")
        if wrong := faults(found, queries):
            raise BrokenContract(f"{name}: " + ", ".join(f"{n} {what}" for what, n in wrong.items()))
        rows = found.select(*[F.col(c).cast(k).alias(c) for c, k in zip(COLUMNS, ("string", "int", "string", "double", "double"), strict=True)]).withColumn("system", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_no_match(found: DataFrame, queries: DataFrame) -> DataFrame:
    """``found`` with a row of rank 0 for each query without an answer."""
    return queries.select("query_id").distinct().join(found, "query_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
