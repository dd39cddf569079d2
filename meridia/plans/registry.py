"""Names of queries, their plans and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def register(ids: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under every one of these operator ids."""

    def add(plan: Plan) -> Plan:
        for name in ids.split():
            if name in QUERIES:
                raise ValueError(f"{name} is registered twice")
            QUERIES[name] = plan
            if sql is not None:
                ORACLES[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_on(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Spark SQL over tables written as ``{name}``."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})
