"""A written index of segment vectors, in versions, with a manifest against which a reuse is verified.

A version is a folder ``version=N`` with ``vectors`` (Parquet, dealt by ranges of
``global_idx``, so that a range of positions is read by statistics alone) and, written last,
``manifest``: a version without one was cut short and is never opened.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.folders import delete
from .encode import Encoder, loaded, spectral_encoder
from .landmarks import Frames, each_tile
from .numbering import numbered

#: Facts of a version that reading it must give again.
_FACTS = ("n_refs", "n_segments", "dim", "last", "digest")


class DamagedIndex(ValueError):
    """The files don't have what the manifest says."""


def encode_segments(chunks: DataFrame, factory: Callable[[], Encoder] = spectral_encoder, frames: Frames = Frames(), batch: int = 1024) -> DataFrame:
    """``clip_id, segment_idx, embedding`` (unit length, 32-bit) for signals in chunks ``clip_id, at, samples``."""

    def run(number: np.ndarray, samples: np.ndarray, own: np.ndarray) -> dict[str, pa.Array]:
        model, samples = loaded(factory), samples[own]
        parts = [model(samples[i : i + batch]) for i in range(0, len(samples), batch)]
        out = np.concatenate(parts) if parts else np.zeros((0, 1))
        out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return {"segment_idx": pa.array(number[own], pa.int64()), "embedding": pa.array(list(out.astype(np.float32)), pa.list_(pa.float32()))}

    return each_tile(chunks, frames, 0, run, "segment_idx long, embedding array<float>")


def _facts(vectors: DataFrame) -> dict:
    row = vectors.agg(
        F.countDistinct("ref_id").alias("n_refs"), F.count("*").alias("n_segments"), F.max(F.size("embedding")).alias("dim"), F.min(F.size("embedding")).alias("least_dim"),
        F.max("global_idx").alias("last"), F.min("global_idx").alias("first"), F.bit_xor(F.xxhash64(*[F.col(c) for c in ("global_idx", "ref_id", "segment_idx", "embedding")])).alias("digest"),
    ).first()
    return row.asDict()


def versions(spark: SparkSession, folder: str) -> dict[int, bool]:
    """Numbers of all versions in the folder, and whether each is complete."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return {v: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={v}/manifest/_SUCCESS")) for v in found}


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """The manifest of a version, or of the last complete one."""
    complete = [v for v, done in versions(spark, folder).items() if done and version in (None, v)]
    if not complete:
        raise FileNotFoundError(f"no complete index in {folder}" + ("" if version is None else f" with version {version}"))
    return spark.read.json(f"{folder}/version={complete[-1]}/manifest").first().asDict() | {"version": complete[-1]}


def build(chunks: DataFrame, folder: str, factory: Callable[[], Encoder] = spectral_encoder, frames: Frames = Frames(), rate: float = 64.0) -> int:
    """Encode all recordings into a new version, and return its number.

    Recordings stand in the order of ``clip_id`` and their segments one after the other: a recording's
    first position is the number of segments before it.  Too short ones have none.
    """
    spark = chunks.sparkSession
    version = max(versions(spark, folder), default=0) + 1
    to, work = f"{folder}/version={version}", f"{folder}/work={version}"
    encode_segments(chunks, factory, frames).write.mode("overwrite").parquet(f"{work}/segments")
    segments = spark.read.parquet(f"{work}/segments")
    sizes = segments.groupBy("clip_id").agg(F.count("*").alias("n"))
    bases = numbered(sizes, ["clip_id"], f"{work}/bases", "place", base="n").select("clip_id", "base")
    rows = segments.join(bases, "clip_id").select(
        (F.col("base") + F.col("segment_idx")).alias("global_idx"), F.col("clip_id").alias("ref_id"), "segment_idx", (F.col("segment_idx") * (frames.hop / rate)).alias("segment_start_sec"), "embedding"
    )
    rows.repartitionByRange("global_idx").sortWithinPartitions("global_idx").write.parquet(f"{to}/vectors")
    facts = _facts(spark.read.parquet(f"{to}/vectors"))
    facts |= {"width": frames.width, "hop": frames.hop, "rate": float(rate), "encoder": f"{factory.__module__}.{factory.__qualname__}", "source": _source(chunks), "schema": rows.schema.json()}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items() if v is not None]).write.json(f"{to}/manifest")
    delete(spark, work)
    return version


def _source(chunks: DataFrame) -> str:
    row = chunks.agg(F.count("*"), F.bit_xor(F.xxhash64("clip_id", "at", "samples"))).first()
    return f"{row[0]}:{row[1]}"


def open_index(spark: SparkSession, folder: str, version: int | None = None, dim: int | None = None) -> DataFrame:
    """The vectors of the last complete version (or of one), once their number, dimension, positions and digest are verified."""
    about = manifest(spark, folder, version)
    vectors = spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).parquet(f"{folder}/version={about['version']}/vectors")
    facts = _facts(vectors)
    wrong = [f"{k} is {facts[k]}, not {about.get(k)}" for k in _FACTS if facts[k] != about.get(k)]
    if facts["n_segments"] and (facts["first"] != 0 or facts["last"] != facts["n_segments"] - 1):
        wrong.append(f"positions {facts['first']} to {facts['last']} of {facts['n_segments']} segments aren't contiguous")
    if facts["least_dim"] != facts["dim"] or dim not in (None, facts["dim"]):
        wrong.append(f"vectors have {facts['least_dim']} to {facts['dim']} components")
    if wrong:
        raise DamagedIndex(f"{folder}, version {about['version']}: " + "; ".join(wrong))
    return vectors


def reuse_or_build(chunks: DataFrame, folder: str, factory: Callable[[], Encoder] = spectral_encoder, frames: Frames = Frames(), rate: float = 64.0) -> tuple[DataFrame, bool]:
    """The verified vectors of ``chunks`` and whether they were there: a version of other samples, frames or encoder, or a damaged one, is built anew."""
    spark = chunks.sparkSession
    try:
        about = manifest(spark, folder)
        same = about["source"] == _source(chunks) and (about["width"], about["hop"], about["rate"]) == (frames.width, frames.hop, float(rate))
        if same and about["encoder"] == f"{factory.__module__}.{factory.__qualname__}":
            return open_index(spark, folder), True
    except (FileNotFoundError, DamagedIndex):
        pass
    return open_index(spark, folder, build(chunks, folder, factory, frames, rate)), False
