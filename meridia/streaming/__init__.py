"""Structured Streaming forms: stream-static identification, sliding windows, carried state, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> list[dict]:
    """Process all files that are there, batch by batch, and return the progress reports."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.__dict__ for p in query.recentProgress]


class Aborted(RuntimeError):
    """The totals of a stream passed a limit; what was written until then stays."""


def run_observed(stream: DataFrame, folder: str, checkpoint: str, metrics: dict[str, Column], abort: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Write a stream's batches below ``folder``, observe ``metrics`` (aggregates) of each on the way, and return them by batch.

    Metrics come from the pass that writes the rows, and are written as ``metrics/batch=N`` beside ``rows/batch=N``;
    a batch that is run again after a failure replaces both.  ``abort``, asked after each batch with
    all metrics so far, ends the run with ``Aborted``; a later run goes on from the checkpoint.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, n: int) -> None:
        seen = Observation()
        batch.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        got = seen.get
        spark.createDataFrame([tuple(got[m] for m in metrics)], kinds).write.mode("overwrite").parquet(f"{folder}/metrics/batch={n}")
        if abort and abort(spark.read.parquet(f"{folder}/metrics")):
            raise Aborted(f"batch {n}")

    kinds = spark.createDataFrame([], stream.schema).agg(*[c.alias(name) for name, c in metrics.items()]).schema
    try:
        run_available(stream, one, checkpoint)
    except Exception as e:
        if "Aborted" in str(e):
            raise Aborted(str(e).splitlines()[0]) from None
        raise
    return spark.read.parquet(f"{folder}/metrics")


def write_counted(table: DataFrame, path: str, **metrics: Column) -> dict:
    """Write Parquet and return the number of rows and further aggregates, observed in the pass that writes."""
    seen = Observation()
    table.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def sliding_counts(events: DataFrame, width: str = "1 hour", hop: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of overlapping event-time windows; late rows beyond the watermark are left out of a stream."""
    table = events.withWatermark("ts", late) if events.isStreaming else events
    return table.groupBy(F.window("ts", width, hop).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def identify(stream: DataFrame, library: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 5) -> list[dict]:
    """Answer queries as they arrive against a static library; one micro-batch is one search."""
    from ..operators.retrieval import sequence_search

    return run_available(stream, lambda batch, n: sink(sequence_search(batch, library, k=k), n), checkpoint)


def read_parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
