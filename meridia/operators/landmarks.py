"""Landmarks of sampled signals: spectra, mel bands, local maxima, and hashes of pairs and triples of maxima.

Signals come in chunks, ``clip_id, at, samples`` (``at``: the number of the chunk's
first sample), so that no clip has to fit a row.  Chunks are dealt to tiles of frames
with a margin on both sides; a tile is one group of bounded size, in which an Arrow
kernel frames the samples and transforms them.  What a tile says about its own frames is
what the whole clip says.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frames:
    """Samples of a frame, samples from one to the next, and frames of a tile."""

    width: int = 64
    hop: int = 32
    tile: int = 1024


def _tiles(chunks: DataFrame, frames: Frames, margin: int) -> DataFrame:
    """Chunks with the tiles (``tile``) that need them; chunks may have any length."""
    size = F.size("samples")
    # tile k needs samples from (k * tile - margin) * hop up to ((k + 1) * tile + margin - 1) * hop + width
    span, lead = frames.tile * frames.hop, margin * frames.hop
    first = F.greatest(F.lit(0), F.floor((F.col("at") - lead + frames.hop - frames.width) / span))
    last = F.floor((F.col("at") + size - 1 + lead) / span)
    return chunks.where(size > 0).select("clip_id", "at", F.col("samples").cast("array<double>").alias("samples"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("tile"))


def _cut(table: pa.Table, frames: Frames, margin: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frame numbers, their samples, and the tile's first own frame."""
    at = np.asarray(table["at"].combine_chunks())
    order = np.argsort(at)
    lists = table["samples"].combine_chunks()
    parts = [np.asarray(lists[int(i)].values, float) for i in order]
    tile = table["tile"][0].as_py()
    low = max(0, tile * frames.tile - margin)
    start, samples = int(at[order[0]]), np.concatenate(parts)
    if int(at[order[0]]) > low * frames.hop or any(int(at[b]) != int(at[a]) + len(p) for a, b, p in zip(order, order[1:], parts, strict=False)):
        raise ValueError(f"chunks of clip {table['clip_id'][0]} leave gaps or overlap")
    samples = samples[low * frames.hop - start :]
    count = min((len(samples) - frames.width) // frames.hop + 1, (tile + 1) * frames.tile + margin - low)
    if count < 1:
        return np.zeros(0, int), np.zeros((0, frames.width)), tile * frames.tile
    return low + np.arange(count), np.lib.stride_tricks.sliding_window_view(samples, frames.width)[:: frames.hop][:count], tile * frames.tile


def _spectrum(samples: np.ndarray) -> np.ndarray:
    """Magnitudes of the Fourier transform of each frame."""
    return np.abs(np.fft.rfft(samples, axis=1))


def each_tile(chunks: DataFrame, frames: Frames, margin: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Rows of ``of`` (numbers and samples of all frames, and which are the tile's own) for each tile."""
    kind = chunks.schema["clip_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        number, samples, first = _cut(table, frames, margin)
        columns = of(number, samples, (number >= first) & (number < first + frames.tile))
        n = len(next(iter(columns.values())))
        return pa.table({"clip_id": pa.array([table["clip_id"][0].as_py()] * n, table.schema.field("clip_id").type), **columns})

    return _tiles(chunks, frames, margin).groupBy("clip_id", "tile").applyInArrow(run, f"clip_id {kind}, {schema}")


def spectrogram(chunks: DataFrame, frames: Frames = Frames()) -> DataFrame:
    """``clip_id, frame, magnitudes``: one row for each whole frame; a clip shorter than a frame has none."""

    def run(number: np.ndarray, samples: np.ndarray, own: np.ndarray) -> dict[str, pa.Array]:
        return {"frame": pa.array(number[own], pa.int64()), "magnitudes": pa.array(list(_spectrum(samples[own])), pa.list_(pa.float64()))}

    return each_tile(chunks, frames, 0, run, "frame long, magnitudes array<double>")


def mel_bands(width: int, rate: float, bands: int) -> np.ndarray:
    """Triangular weights of ``bands`` bands, evenly spaced on the mel scale, over the bins of a frame."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    hz = np.arange(width // 2 + 1) * rate / width
    up = (hz - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - hz) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(chunks: DataFrame, rate: float, bands: int = 16, frames: Frames = Frames(), floor: float = 1e-10) -> DataFrame:
    """``clip_id, frame, mel``: decibels of the power in each mel band, not below those of ``floor``."""
    weights = mel_bands(frames.width, rate, bands)

    def run(number: np.ndarray, samples: np.ndarray, own: np.ndarray) -> dict[str, pa.Array]:
        power = (_spectrum(samples[own]) ** 2) @ weights.T
        return {"frame": pa.array(number[own], pa.int64()), "mel": pa.array(list(10 * np.log10(np.maximum(power, floor))), pa.list_(pa.float64()))}

    return each_tile(chunks, frames, 0, run, "frame long, mel array<double>")


def peaks(chunks: DataFrame, frames: Frames = Frames(), bins: int = 3, spread: int = 15, least: float = 0.0) -> DataFrame:
    """``clip_id, frame, bin, magnitude`` of local maxima: none larger within ``bins`` bins and ``spread`` frames on each side.

    Magnitudes are rounded to six places and larger than ``least``; equal neighbours are all maxima.
    """

    def run(number: np.ndarray, samples: np.ndarray, own: np.ndarray) -> dict[str, pa.Array]:
        value = np.round(_spectrum(samples), 6)
        most = value
        for axis, reach in ((0, spread), (1, bins)):
            edge = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
            most = np.lib.stride_tricks.sliding_window_view(np.pad(most, edge, constant_values=-np.inf), 2 * reach + 1, axis=axis).max(axis=-1) if len(most) else most
        frame, at = np.nonzero((value >= most) & (value > least) & own[:, None])
        return {"frame": pa.array(number[frame], pa.int64()), "bin": pa.array(at, pa.int32()), "magnitude": pa.array(value[frame, at], pa.float64())}

    return each_tile(chunks, frames, spread, run, "frame long, bin int, magnitude double")


def _fans(found: DataFrame, fan: int, reach: int, extra: Callable[[Column], Column]) -> DataFrame:
    """Each peak with the ``fan`` next ones of its clip (by frame, then bin) within ``reach`` frames, as ``b``.

    Peaks are dealt to stretches of ``reach`` frames and lent to the stretch before, so no window holds a clip.
    """
    tile = F.floor(F.col("frame") / reach)
    dealt = found.select("*", F.explode(F.array(F.struct(tile.alias("tile"), F.lit(True).alias("own")), F.struct((tile - 1).alias("tile"), F.lit(False).alias("own")))).alias("x")).select("*", "x.*").drop("x")
    order = Window.partitionBy("clip_id", "tile").orderBy("frame", "bin")
    later = dealt.withColumn("b", F.array(*[F.lead(F.struct("frame", "bin"), i).over(order) for i in range(1, fan + 1)])).where("own")
    near = F.filter("b", lambda b: b.isNotNull() & (b["frame"] - F.col("frame") <= reach))
    return later.select("clip_id", "frame", "bin", F.explode(extra(near)).alias("b"))


def pair_hashes(found: DataFrame, fan: int = 3, reach: int = 63) -> DataFrame:
    """``clip_id, hash, t``: two peaks packed as 9 bits of each bin and 14 of the frames between; t is the first one's frame."""
    pairs = _fans(found, fan, min(reach, 16383), lambda near: near)
    code = F.shiftleft((F.col("bin").cast("long") % 512), 23).bitwiseOR(F.shiftleft(F.col("b.bin").cast("long") % 512, 14)).bitwiseOR(F.col("b.frame") - F.col("frame"))
    return pairs.select("clip_id", code.alias("hash"), F.col("frame").alias("t"))


def triplet_hashes(found: DataFrame, fan: int = 4, reach: int = 63, steps: int = 64) -> DataFrame:
    """``clip_id, hash, t``: three peaks packed by the steps between their bins (10 bits each) and the share of the time to the second.

    Steps and shares stay when a clip is transposed or played at another speed.
    """
    pick = lambda near: F.flatten(F.transform(near, lambda b, i: F.transform(F.slice(near, i + 2, fan), lambda c: F.struct(b.alias("m"), c.alias("z")))))
    three = _fans(found, fan, reach, pick).where("b.z.frame > frame")
    step = lambda x, y: (y.cast("long") - x.cast("long") + 512)
    share = F.least(F.lit(steps - 1), F.floor((F.col("b.m.frame") - F.col("frame")) * steps / (F.col("b.z.frame") - F.col("frame"))))
    code = F.shiftleft(step(F.col("bin"), F.col("b.m.bin")), 20).bitwiseOR(F.shiftleft(step(F.col("b.m.bin"), F.col("b.z.bin")), 10)).bitwiseOR(share)
    return three.select("clip_id", code.alias("hash"), F.col("frame").alias("t"))
