"""Parts of files: headers of sound files, directories and members of archives, read by ranges in tasks.

No file is read whole: a header scan reads some hundred bytes of each file, and an archive gives its
directory and the wanted members.  Paths are those that Spark lists.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks of a sound file looked at before its samples, at most.
MAX_CHUNKS = 64
#: Files that a task writes to one folder; a folder is listed and read by one task.
FOLDER_FILES = 1_000
#: A name in a path: of a file (see ``write_files``), or of the folder that Spark's own writer makes for it.
_NAMED = r"(?:^|/)name=([^/]*?)(?:\.\d+|/[^/]+)$"
_HEADER = "path string, state string, error string, samplerate int, channels int, bits int, frames long, duration_sec double, size_bytes long, bytes_read long"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store that holds a path or URI, and the path in it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(path)


def open_file(path: str) -> pa.NativeFile:
    """A file by the path or URI that Spark gives it, to be read by ranges."""
    system, inner = _store(path)
    return system.open_input_file(inner)


def opens(path: str) -> bool:
    """Whether ``open_file`` knows the store that holds a path; others are read by Spark only, whole."""
    try:
        open_file(path).close()
    except (OSError, ValueError):  # ValueError: an unknown scheme
        return False
    return True


def _wav_header(path: str) -> dict:
    row = dict.fromkeys((c.split()[0] for c in _HEADER.split(", "))) | {"path": path, "state": "error", "bytes_read": 0}

    def read(file: pa.NativeFile, n: int, at: int) -> bytes:
        data = file.read_at(n, at)
        row["bytes_read"] += len(data)
        return data

    try:
        with open_file(path) as file:
            row["size_bytes"] = size = file.size()
            start = read(file, 12, 0)
            if start[:4] != b"RIFF" or start[8:12] != b"WAVE":
                return row | {"error": "not a WAV file"}
            at, kind = 12, None
            for _ in range(MAX_CHUNKS):
                head = read(file, 8, at)
                if len(head) < 8:
                    return row | {"error": "no samples"}
                name, length = struct.unpack("<4sI", head)
                if name == b"fmt ":
                    body = read(file, 16, at + 8)
                    if len(body) < 16:
                        return row | {"error": "cut short"}
                    _, row["channels"], row["samplerate"], _, kind, row["bits"] = struct.unpack("<HHIIHH", body)
                if name == b"data":
                    if not kind or not row["samplerate"]:
                        return row | {"error": "no format"}
                    row["frames"] = length // kind
                    row["duration_sec"] = row["frames"] / row["samplerate"]
                    return row | ({"error": "cut short"} if at + 8 + length > size else {"state": "ok"})
                at += 8 + length + length % 2
            return row | {"error": "too many chunks"}
    except FileNotFoundError:
        return row | {"state": "missing"}
    except (OSError, struct.error) as e:
        return row | {"error": type(e).__name__}


def wav_headers(files: DataFrame) -> DataFrame:
    """For each ``path``: ``state`` (ok, missing or error), rate, channels, bits, frames, seconds and sizes, from the file's first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_wav_header(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("state", pa.string()), ("error", pa.string()), ("samplerate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("duration_sec", pa.float64()), ("size_bytes", pa.int64()), ("bytes_read", pa.int64())]))

    return files.select("path").where("path is not null").mapInArrow(run, _HEADER)


def zip_listing(files: DataFrame) -> DataFrame:
    """``path, member, size, packed, crc, error``: the directories of zip archives; one that can't be read gives a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("crc", pa.int64()), ("error", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open_file(path) as file, zipfile.ZipFile(file) as archive:
                        rows = [{"path": path, "member": i.filename, "size": i.file_size, "packed": i.compress_size, "crc": i.CRC, "error": None} for i in archive.infolist() if not i.is_dir()]
                except (OSError, ValueError, zipfile.BadZipFile) as e:  # ValueError: too short for a directory
                    rows = [{"path": path, "error": type(e).__name__ if isinstance(e, OSError) else "BadZipFile"}]
                yield from pa.Table.from_pylist(rows, kinds).to_batches(10_000)

    return files.select("path").where("path is not null").mapInArrow(run, "path string, member string, size long, packed long, crc long, error string")


def zip_members(listed: DataFrame) -> DataFrame:
    """``path, member, content, error`` of listed members, one member at a time; members are dealt evenly, whatever archive they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        opened, file, archive = None, None, None
        for batch in batches:
            for path, member in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                row = {"path": path, "member": member, "content": None, "error": None}
                try:
                    if path != opened:
                        opened, file = None, open_file(path)
                        opened, archive = path, zipfile.ZipFile(file)
                    row["content"] = archive.read(member)
                except (OSError, ValueError, KeyError, zipfile.BadZipFile) as e:
                    row["error"] = type(e).__name__
                yield pa.RecordBatch.from_pylist([row], kinds)

    rows = listed.select("path", "member").where("member is not null")
    return rows.repartition("path", "member").sortWithinPartitions("path", "member").mapInArrow(run, "path string, member string, content binary, error string")


def writes(folder: str) -> bool:
    """Whether tasks can write files below a folder by themselves; other stores are written by Spark only."""
    try:
        _store(folder)
    except (OSError, ValueError):
        return False
    return True


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """A file for each row of ``name, content``, a line feed after the content; returns the ``path, length`` that the store lists.

    A task fills folders of its own, of ``FOLDER_FILES`` files each, and says which are done.  Only these are listed, so
    the files of a task that failed or ran twice count once, and neither names nor paths go through the driver.
    """
    spark, rows = rows.sparkSession, rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    if not writes(folder):
        rows.select(F.url_encode("name").alias("name"), F.col("content").cast("string").alias("content")).write.partitionBy("name").text(folder)
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, own, n = None, "", 0
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                if not n:
                    own = f"{folder}/files/{uuid.uuid4().hex}"
                    store, inner = _store(own)
                    store.create_dir(inner, recursive=True)
                file = f"name={quote(name.as_py(), safe='')}.{n}" if name.is_valid else f"none.{n}"
                with store.open_output_stream(f"{inner}/{file}") as out:
                    out.write(content.as_py() or b"")
                    out.write(b"\n")
                n += 1
                if n == FOLDER_FILES:
                    n = 0
                    yield pa.RecordBatch.from_pydict({"folder": [own]})
        if n:
            yield pa.RecordBatch.from_pydict({"folder": [own]})

    rows.mapInArrow(write, "folder string").write.parquet(f"{folder}/done")
    return files_in(spark.read.schema("folder string").parquet(f"{folder}/done"))


def files_in(folders: DataFrame) -> DataFrame:
    """``path, length`` of the files in each ``folder``; a task for each folder, so folders should have thousands of files at most."""
    kinds = pa.schema([("path", pa.string()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, inner = _store(folder)
                found = [i for i in store.get_file_info(fs.FileSelector(inner)) if i.is_file]
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{quote(i.base_name, safe='=')}" for i in found], pa.string()), pa.array([i.size for i in found], pa.int64())], schema=kinds)

    return folders.select("folder").repartition(max(1, min(4096, folders.count()))).mapInArrow(run, "path string, length long")


def name_of(path: Column | str) -> Column:
    """The name of a file that ``write_files`` wrote, from its path; null if it had none."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(path.rlike(_NAMED), F.url_decode(F.url_decode(F.regexp_extract(path, _NAMED, 1))))
