"""Parts of sampled signals, and the same at another rate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the low-pass filter on each side.
CROSSINGS = 16


def cut(chunks: DataFrame, queries: DataFrame, chunk: int) -> DataFrame:
    """``query_id, samples`` for ``query_id, clip_id, start, length`` in samples, of signals in chunks ``clip_id, at, samples``.

    All chunks but a clip's last have ``chunk`` samples, so a range is an equi-join on the few chunks
    that it touches; the rest of a signal stays where it is.  A range is cut off at the signal's end.
    """
    asked = queries.where("length > 0 and start >= 0")
    last = F.floor((F.col("start") + F.col("length") - 1) / chunk)
    asked = asked.withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / chunk), last)))
    parts = chunks.select("clip_id", F.floor(F.col("at") / chunk).alias("part"), "at", "samples")
    low, high = F.greatest(F.col("start") - F.col("at"), F.lit(0)), F.col("start") + F.col("length") - F.col("at")
    piece = F.slice("samples", low.cast("int") + 1, F.greatest(F.least(high, F.size("samples")) - low, F.lit(0)).cast("int"))
    met = asked.join(parts, ["clip_id", "part"]).select("query_id", "at", piece.alias("piece"))
    lists = met.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("l"))
    return lists.select("query_id", F.flatten(F.transform("l", lambda x: x["piece"])).alias("samples"))


def _resampled(x: np.ndarray, source: float, target: float) -> np.ndarray:
    share = min(1.0, target / source)  # of the band that is kept
    reach = CROSSINGS / share
    centre = np.arange(int(np.floor(len(x) * target / source + 1e-9))) * (source / target)
    out = np.zeros(len(centre))
    for low in range(0, len(centre), 4096):
        c = centre[low : low + 4096, None]
        at = np.floor(c - reach).astype(np.int64) + 1 + np.arange(int(np.ceil(2 * reach)) + 1)
        away = c - at
        weight = np.where(np.abs(away) < reach, share * np.sinc(share * away) * (0.5 + 0.5 * np.cos(np.pi * away / reach)), 0)
        inside = (at >= 0) & (at < len(x))
        out[low : low + 4096] = (np.where(inside, x[np.clip(at, 0, max(0, len(x) - 1))] if len(x) else 0, 0) * weight).sum(axis=1)
    return out


def resample(rows: DataFrame, source: float, target: float) -> DataFrame:
    """``rows`` with ``samples`` at ``target`` a second in place of ``source``, by a windowed low-pass filter; zeros lie around a signal."""
    if source <= 0 or target <= 0:
        raise ValueError("rates are larger than zero")
    names = rows.columns
    rows = rows.withColumn("samples", F.col("samples").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index("samples"))
            new = [None if x is None else _resampled(np.array(x, float), source, target) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.list_(pa.float64())) if c == "samples" else batch.column(c) for c in names], names)

    return rows.mapInArrow(run, rows.schema)
