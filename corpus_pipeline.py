"""A corpus through five stages: quality, line dedup, near dedup, decontamination, tokens.

The stages are in ``meridia.llm.stages``; each takes ``(spark, docs, sf_dir)``
and all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import stages

STAGES = stages.STAGES
#: Stages fit a model and follow links: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    return stages.run(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
