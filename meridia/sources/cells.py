"""Results by cell (split and length), system and seed: names, pruned reads, exports of what is there."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How a cell is named, and the folders of a system's run of it.
CELL = re.compile(r"(main|ablation)_(\d+)s")
TEMPLATE = "system={system}/split={split}/length_s={length}/seed={seed}"


def cell_of(name: str) -> tuple[str, int]:
    """Split and length in seconds of a cell's name, such as ``main_3s``."""
    found = CELL.fullmatch(name)
    if not found:
        raise ValueError(f"{name!r} is no cell")
    return found[1], int(found[2])


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_runs(results: DataFrame, folder: str) -> None:
    """Results with ``system, split, length_s, seed``, a folder for each."""
    results.write.mode("overwrite").partitionBy("system", "split", "length_s", "seed").parquet(folder)


def path_of(folder: str, system: str, cell: str, seed: int) -> str:
    split, length = cell_of(cell)
    return f"{folder}/" + TEMPLATE.format(system=system, split=split, length=length, seed=seed)


def read_runs(spark: SparkSession, folder: str, runs: list[tuple[str, str, int]]) -> tuple[DataFrame | None, list[tuple[str, str, int]]]:
    """Rows of the runs ``(system, cell, seed)`` that are there, and the runs that aren't; only their folders are listed and read."""
    paths = {run: path_of(folder, *run) for run in runs}
    there = [run for run in runs if exists(spark, paths[run])]
    table = spark.read.option("basePath", folder).parquet(*[paths[r] for r in there]) if there else None
    return table, [r for r in runs if r not in there]


def export(spark: SparkSession, sources: dict[str, str], folder: str) -> DataFrame:
    """Copy each data set that is there to ``folder/name``: ``name, state, rows`` with state copied or missing; rows are counted while they are written."""
    from ..streaming import write_counted

    done = [(n, "copied", write_counted(spark.read.parquet(p), f"{folder}/{n}")["n"]) if exists(spark, p) else (n, "missing", None) for n, p in sources.items()]
    parts = [spark.range(1).select(F.lit(n).alias("name"), F.lit(state).alias("state"), F.lit(rows).cast("long").alias("rows")) for n, state, rows in done]
    return reduce(DataFrame.unionByName, parts)


def write_json(table: DataFrame, folder: str, *by: str) -> None:
    """Statistics as JSON, a folder for each value of ``by`` and one line for each row."""
    (table.write.partitionBy(*by) if by else table.coalesce(1).write).mode("overwrite").json(folder)


def read_json(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """All reports below the folders as one table, with ``path``; a report that lacks a field has null there."""
    table = spark.read.schema(schema).option("recursiveFileLookup", True).json(folders)
    return table.withColumn("path", F.input_file_name())


def markdown(table: DataFrame, title: str, columns: dict[str, str], order: list[str]) -> DataFrame:
    """``place, line`` of a Markdown report: a title, a table's head, and a line for each row in ``order``; null is ``-``.

    ``columns``: heads and formats (as of ``format_string``) of the columns of ``table``; reports are of aggregated tables.
    """
    head = ["# " + title, "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    spark = table.sparkSession
    cells = [F.when(F.col(c).isNull(), "-").otherwise(F.format_string(form, F.col(c))) for c, form in columns.items()]
    body = table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)])
    body = body.select((F.row_number().over(Window.orderBy(*[f"__{i}" for i in range(len(order))])) + len(head)).cast("long").alias("place"), "line")  # one row for each line of a report
    top = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in head])).alias("place", "line")).select((F.col("place") + 1).cast("long").alias("place"), "line")
    return top.unionByName(body)
