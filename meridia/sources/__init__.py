"""Readers and writers: manifests, results, logs, file listings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType()}


def _struct(columns: str) -> T.StructType:
    """Columns as ``name type, ...``, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, columns.split(","))])


#: The columns of manifests and of ranked results.
REFS = _struct("ref_id string, corpus string, source_track_id string, audio_path string, duration_sec double, samplerate int, channels int, role string")
QUERIES = _struct("query_id string, ref_id string, corpus string, audio_path string, offset_sec double, length_sec double, seed bigint")
RESULTS = _struct(
    "system string, split string, length_s int, seed bigint, query_id string, rank int, predicted_ref_id string, predicted_segment_id bigint, match_count int, score double,"
    " ref_start double, ref_stop double, query_start double, query_stop double, latency_ms double"
)


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV files with headers as one table, by an explicit schema; NaN becomes null."""
    table = spark.read.schema(schema).option("header", True).csv(paths)
    floats = [f.name for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return table.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def write_csv(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_results(results: DataFrame, path: str, *by: str) -> None:
    """Results as Parquet by ``system, split, length_s``; a system, split or length is read by pruning."""
    results.write.mode("overwrite").partitionBy(*(by or ("system", "split", "length_s"))).parquet(path)


def read_results(spark: SparkSession, path: str, **cell) -> DataFrame:
    """The results of a cell; a cell that was not written gives no rows."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], RESULTS)
    table = spark.read.parquet(path)
    for name, value in cell.items():
        table = table.where(F.col(name) == value)
    return table


def artefacts(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """``name`` (path below the folder), ``length, sha256`` of all files below a folder; files of more than ``most`` bytes are read in ranges."""
    from . import checksums, ranged

    most = most or checksums.RANGE
    below = re.sub(r"^\w+:(//[^/]*)?", "", path).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    large = files.where(F.col("length") > most).select("path", "length")
    first = large.first()
    by_ranges = first is not None and ranged.opens(first["path"])
    whole = files.where(F.col("length") <= most) if by_ranges else files
    found = whole.select("path", "length", F.sha2("content", 256).alias("sha256"))
    if by_ranges:
        found = found.unionByName(checksums.sha256(large, most))
    return found.select(F.substring_index("path", below, -1).alias("name"), "length", "sha256")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def split_valid(table: DataFrame, **reasons) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and the others with ``reasons``, the names of the conditions they meet."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons.items()]), lambda x: x.isNotNull())
    marked = table.withColumn("reasons", found)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)
