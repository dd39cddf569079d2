"""SHA-256 of files of any size: the state of a hash is handed from task to task, so each reads a bounded range."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import _hashlib
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import new_folder
from .ranged import open_file

#: Bytes that a task reads of one file; larger files are read in turns.
RANGE = 256 << 20
_PIECE = 8 << 20


class _State(ctypes.Structure):
    """``SHA256_CTX`` of OpenSSL: plain numbers, so its bytes can be stored and taken up by another task."""

    _fields_ = [("h", ctypes.c_uint * 8), ("low", ctypes.c_uint), ("high", ctypes.c_uint), ("data", ctypes.c_uint * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint)]


def _openssl() -> ctypes.CDLL | None:
    """The library behind ``hashlib``, if its states can be stored."""
    try:
        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes = [ctypes.c_void_p]
        lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    except (OSError, AttributeError):
        return None
    return lib


def _pieces(path: str, at: int, stop: int) -> Iterator[bytes]:
    with open_file(path) as file:
        while at < stop:
            piece = file.read_at(min(_PIECE, stop - at), at)
            if not piece:
                raise OSError(f"{path} is shorter than its listing says")
            yield piece
            at += len(piece)


def _further(path: str, length: int, at: int, state: bytes | None, most: int) -> tuple[int, bytes | None, str | None]:
    """Place, state and, at the end, checksum of a file after ``most`` more bytes; without OpenSSL, after all of it."""
    lib = _openssl()
    if lib is None:
        whole = hashlib.sha256()
        for piece in _pieces(path, 0, length):
            whole.update(piece)
        return length, None, whole.hexdigest()
    if state is None:
        own = _State()
        lib.SHA256_Init(ctypes.byref(own))
    else:
        own = _State.from_buffer_copy(state)
    stop = min(length, at + most)
    for piece in _pieces(path, at, stop):
        lib.SHA256_Update(ctypes.byref(own), piece, len(piece))
    if stop < length:
        return stop, bytes(own), None
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, ctypes.byref(own))
    return stop, None, out.raw.hex()


def of_files(files: DataFrame, most: int = RANGE) -> DataFrame:
    """``path, length, sha256`` of listed files of ``path, length``, read in pieces by the task that has them; those of more than ``most`` bytes in ranges."""
    kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = hashlib.sha256()
                for piece in _pieces(path, 0, length):
                    whole.update(piece)
                found.append(whole.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], schema=kinds)

    found = files.where(F.col("length") <= most).select("path", "length").mapInArrow(run, "path string, length long, sha256 string")
    large = files.where(F.col("length") > most)
    return found if large.isEmpty() else found.unionByName(sha256(large, most))


def sha256(files: DataFrame, most: int = RANGE) -> DataFrame:
    """``path, length, sha256`` of listed files of ``path, length``.

    Turn by turn, a task reads ``most`` further bytes of one file and stores the hash's state of 112 bytes;
    all files move on at once.  There are as many turns as the largest file has ranges.
    """
    spark, folder = files.sparkSession, new_folder(files.sparkSession)
    kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("at", pa.int64()), ("state", pa.binary()), ("sha256", pa.string())])
    columns = "path string, length long, at long, state binary, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, at, state in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at, state, found = _further(path, length, at, state, most)
                yield pa.RecordBatch.from_pylist([{"path": path, "length": length, "at": at, "state": state, "sha256": found}], kinds)

    n, largest = files.agg(F.count("*"), F.coalesce(F.max("length"), F.lit(0))).first()
    waiting = files.select("path", F.col("length").cast("long").alias("length"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("state"))
    turns = max(1, -(-largest // most))
    for i in range(turns):
        dealt = waiting.repartitionByRange(n, "path") if n > 1 else waiting
        dealt.mapInArrow(run, columns).write.parquet(f"{folder}/turn={i}")
        waiting = spark.read.schema(columns).parquet(f"{folder}/turn={i}").where("sha256 is null").drop("sha256")
    return spark.read.schema(columns).parquet(*[f"{folder}/turn={i}" for i in range(turns)]).where("sha256 is not null").select("path", "length", "sha256")
