"""Row numbers and running sums over a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(table: DataFrame, order: list[str], folder: str, name: str = "n", **before: str) -> DataFrame:
    """Adds ``name``: the place of each row in the order of the columns ``order``, from 0.

    ``before``: further names and the columns of whole numbers whose sum over all rows before they hold
    (null counts as 0).  Rows are dealt by range and written to ``folder`` (shared by the driver and
    all executors), so that each range stays as it is; a row's number is its place
    in its range and the size of the ranges before, of which there are as many as
    partitions.  Rows that agree in ``order`` come in any order.  A column that
    most rows share gives large ranges: end ``order`` with a key.
    """
    ranged = table.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged.write.parquet(folder)
    ranged = table.sparkSession.read.schema(ranged.schema).parquet(folder)
    sums = {name: F.lit(1), **{k: F.coalesce(F.col(c), F.lit(0)) for k, c in before.items()}}
    ranges = ranged.groupBy("__range").agg(*[F.sum(c).cast("long").alias(f"__of_{k}") for k, c in sums.items()])  # a row for each partition
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("__range", *[F.coalesce(F.sum(f"__of_{k}").over(earlier), F.lit(0)).alias(f"__of_{k}") for k in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"__in_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(starts, "__range")
    return out.select(*table.columns, *[(F.col(f"__in_{k}") + F.col(f"__of_{k}")).cast("long").alias(k) for k in sums])
