"""Encoders behind one contract: samples in, one unit vector per window out.

An encoder is built once per Python worker by a factory and called with a
matrix of windows; models themselves are not part of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import windows

Encoder = Callable[[np.ndarray], np.ndarray]
_loaded: dict[str, Encoder] = {}


def spectral_encoder() -> Encoder:
    """A stand-in without weights: magnitudes of the Fourier transform on a mel-like scale."""

    def run(batch: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft(batch, axis=1))
        mel = 2595 * np.log10(1 + np.arange(power.shape[1]) / 7)
        bands = np.minimum(15, (16 * mel / max(mel[-1], 1e-9)).astype(int))
        return np.log1p(np.stack([power[:, bands == b].sum(axis=1) for b in range(16)], axis=1))

    return run


def loaded(factory: Callable[[], Encoder]) -> Encoder:
    """The worker's encoder of this factory, built once."""
    name = f"{factory.__module__}.{factory.__qualname__}"
    return _loaded.get(name) or _loaded.setdefault(name, factory())


def encode(clips: DataFrame, factory: Callable[[], Encoder] = spectral_encoder, width: int = 16, hop: int = 8, batch: int = 256) -> DataFrame:
    """``clip_id, segment_idx, embedding`` for ``(clip_id, samples)``: windows, encoder in batches, unit length.

    A clip shorter than a window has no segment.
    """
    parts = clips.select("clip_id", F.explode(windows(F.col("samples"), width, hop)).alias("w")).select("clip_id", F.col("w.at").alias("segment_idx"), F.transform("w.window", lambda x: x.cast("double")).alias("window"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(factory)
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                out = model(np.stack(part["window"].to_list()))
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"clip_id": part["clip_id"], "segment_idx": part["segment_idx"], "embedding": list(out)})

    return parts.mapInPandas(run, f"clip_id {clips.schema['clip_id'].dataType.simpleString()}, segment_idx int, embedding array<double>")
