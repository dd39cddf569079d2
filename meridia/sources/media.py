"""Sound files: WAV decoding, archive members, writing; by the standard library only."""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "path string, samplerate int, channels int, samples array<double>, error string"


def _wav(path: str, content: bytes) -> dict:
    """Integer samples of 8 (unsigned), 16, 24 or 32 bits, channels mixed to one, in [-1, 1]."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            data, width = np.frombuffer(w.readframes(w.getnframes()), np.uint8), w.getsampwidth()
            if width == 1:
                data = data.astype(float) - 128
            elif width == 3:
                data = np.pad(data.reshape(-1, 3), ((0, 0), (1, 0))).copy().view("<i4").ravel() / 256
            else:
                data = data.view(f"<i{width}").astype(float)
            mono = data.reshape(-1, w.getnchannels()).mean(axis=1) / 2 ** (8 * width - 1)
            return {"path": path, "samplerate": w.getframerate(), "channels": w.getnchannels(), "samples": mono, "error": None}
    except (wave.Error, EOFError, ValueError) as e:
        return {"path": path, "samplerate": None, "channels": None, "samples": None, "error": type(e).__name__}


def decode_wav(files: DataFrame) -> DataFrame:
    """WAV files ``(path, content)`` as mono samples; what can't be read keeps its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_wav(path, content) for path, content in zip(frame["path"], frame["content"], strict=True)], columns=["path", "samplerate", "channels", "samples", "error"])

    return files.select("path", "content").mapInPandas(run, _SCHEMA)


def zip_files(members: DataFrame, key: str) -> DataFrame:
    """``key, content``: a zip archive of the rows ``member, content`` of each key, which is a group of bounded size."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for member, content in sorted(zip(frame["member"], frame["content"], strict=True)):
                archive.writestr(member, bytes(content))
        return pd.DataFrame({key: [frame[key].iloc[0]], "content": [out.getvalue()]})

    return members.groupBy(key).applyInPandas(run, f"{key} {members.schema[key].dataType.simpleString()}, content binary")


def wav_bytes(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """Samples in [-1, 1], channel by channel, as a 16-bit WAV file; not finite ones are an error."""
    if not np.isfinite(samples).all():
        raise ValueError("samples must be finite")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(samples * 32767, -32768, 32767).astype(np.int16).tobytes())
    return out.getvalue()


def encode_wav(clips: DataFrame, rate: int, channels: int = 1) -> DataFrame:
    """``path, content`` for ``(path, samples)``, to be written by any binary sink."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "content": [wav_bytes(np.asarray(s, float), rate, channels) for s in frame["samples"]]})

    return clips.select("path", "samples").mapInPandas(run, "path string, content binary")


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
