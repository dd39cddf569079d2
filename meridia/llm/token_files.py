"""Token ids in binary files, with a minimal perfect hash index from document keys to their places.

Folder of one data set:

* ``ids/part-NNNNN-*``: the shards, in ascending order of the key.  A shard is blocks
  of ids (little-endian, 2 or 4 bytes each, as ``manifest`` says), each block followed by one byte
  0x0A, and at its end a footer: an Arrow stream ``key, offset, n`` with a row for each
  document, the footer's length in 8 bytes, ``MAGIC``, and one byte 0x0A.
* ``index``: Parquet, a row for each bucket of keys.  A bucket holds a minimal
  perfect hash of its keys: levels of bits, in which a key's place is the one bit that no
  other key of that level took; the number of bits set before it is its slot.
  Slots hold a fingerprint, shard, byte offset, number of ids and first position.
* ``manifest``: Parquet, one row.

A key is found by hashing it to its bucket and slot, comparing the fingerprint and reading
one range of one file, whatever the number of documents.  Buckets are found
by hash, so they are even for any keys.

Rows that share a key, null too, are numbered by ``repeat`` from 0 (in order of
a hash of their text; equal texts in any order, which are alike), so that every row can be had.
Spark writes the shards through its own commit protocol: a task that is run again
leaves one copy.
"""

from __future__ import annotations

import io
import re
import struct
from array import array
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Kept, bound_batches

MAGIC = b"TOKIDS01"
#: Text bytes of a shard (about), bytes of one read, and keys of a bucket, on average.
SHARD_BYTES, READ_BYTES, BUCKET_KEYS = 16 << 20, 4 << 20, 4096
#: Text bytes encoded at once, and words whose ids a worker keeps, of those met once and again; it drops them beyond.
TEXT_BYTES, SEEN, KNOWN = 8 << 20, 300_000, 600_000
#: Latin letters of one code point each, which no normal form changes.
LETTERS = "".join(chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))
_TAIL = struct.Struct("<q8s")
_encoders = Kept()


# encoding


class Encoder:
    """Ids of whole texts with the tokenizers library, without special tokens.

    ``apart``: the tokenizer drops white space and takes A to Z as a to z, a word of Latin letters is one
    piece, whose characters it treats one by one, and a ``.`` or ``,`` that ends a word after a letter is a piece of
    its own.  Then a text may be cut at ASCII white space, and the library encodes each different word once (one of
    letters by its model, after its normaliser and pre-tokeniser have given the form of each letter);
    words that come again are kept.  Otherwise it gets whole texts.
    """

    def __init__(self, definition: str, apart: bool, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.apart, self.kind = Tokenizer.from_str(definition), apart, np.dtype(f"<u{width}")
        self.code = next(c for c in "HIL" if array(c).itemsize == width)
        self.model, split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        form = lambda c: "".join(x for x, _ in split.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c)))
        self.forms = {ord(c): form(c) for c in LETTERS} if apart else {}
        self.letters = re.compile(f"[{LETTERS}]+").fullmatch
        self.seen: dict[str, bytes] = {}  # words met once since it was last emptied
        self.known: dict[str, bytes] = {}  # words met again

    def _run(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 4096):
            out += [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        if len(self.seen) > SEEN:
            self.seen.clear()
        if len(self.known) > KNOWN:
            self.known.clear()
        out, new = list(map(self.known.get, words)), {}
        open_ = [i for i, ids in enumerate(out) if ids is None]
        for i in open_:
            word = words[i]
            if (ids := self.seen.pop(word, None)) is not None:
                self.known[word] = out[i] = ids
            elif word[-1:] in (".", ",") and len(word) > 1 and ord(word[-2]) in self.forms:
                new[word[:-1]] = new[word[-1]] = None
            else:
                new[word] = None
        new, other = [w for w in new if w not in self.known and w not in self.seen], []
        for word in new:
            if self.letters(word):
                self.seen[word] = array(self.code, [t.id for t in self.model.tokenize(word.translate(self.forms))]).tobytes()
            else:
                other.append(word)
        self.seen.update(zip(other, self._run(other), strict=True))
        find = lambda w: self.seen[w] if w in self.seen else self.known[w]
        for i in open_:
            if out[i] is None:
                if words[i] not in self.seen and words[i] not in self.known:
                    self.seen[words[i]] = find(words[i][:-1]) + find(words[i][-1])
                out[i] = find(words[i])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text's."""
        if not self.apart:
            ids = self._run(texts.to_pylist())
            return np.frombuffer(b"".join(ids), self.kind), np.array([len(x) // self.kind.itemsize for x in ids], np.int64)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten().dictionary_encode()
        ids = self._words(words.dictionary.to_pylist())
        size = np.array([len(x) // self.kind.itemsize for x in ids] + [0], np.int64)
        start = np.cumsum(size) - size
        store, index = np.frombuffer(b"".join(ids), self.kind), np.asarray(words.indices)
        parts = []
        for i in range(0, len(index), 1 << 18):
            n = size[index[i : i + (1 << 18)]]
            stop = np.cumsum(n)
            parts.append(store[np.repeat(start[index[i : i + (1 << 18)]] - stop + n, n) + np.arange(stop[-1])])
        upto = np.concatenate([[0], np.cumsum(size[index])])
        edges = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        return np.concatenate(parts) if parts else store[:0], np.diff(upto[edges])


def _encoder(definition: str, apart: bool, width: int) -> Encoder:
    return _encoders.take((hash(definition), apart, width), lambda: Encoder(definition, apart, width))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of batches together, in blocks of some MB."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= TEXT_BYTES:
            yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            held = []
    if sum(map(len, held)):
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))


def _rest() -> None:
    _encoders.rest()


def _footer(keys: list[pa.Array], offsets: np.ndarray, counts: np.ndarray) -> bytes:
    sink = io.BytesIO()
    table = pa.table({"key": pa.chunked_array(keys), "offset": pa.array(offsets, pa.int64()), "n": pa.array(counts, pa.int64())})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    body = sink.getvalue()
    return body + _TAIL.pack(len(body), MAGIC)


def write_ids(docs: DataFrame, folder: str, definition: str, end_id: int | None = None, apart: bool = False, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``text`` (null: empty) by the tokenizer ``definition`` (JSON), and write shards, index and manifest.

    ``end_id`` is added to each document.  Extra columns are not looked at; an empty table gives no shard.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer = Tokenizer.from_str(definition)
    width = 2 if max(tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    shipped = spark.sparkContext.broadcast(definition)  # a tokenizer's file
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("key"), F.xxhash64("text")]  # a key of very many rows spans shards
    rows = rows.repartitionByRange(max(1, -(-size // SHARD_BYTES)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, apart, width)
        keys, offsets, counts, at = [], [], [], 0
        out = lambda data: pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])
        for own, texts in _gathered(batches):
            ids, n = encoder.encode(texts)
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            keys.append(own)
            counts.append(n)
            offsets.append(at + (np.cumsum(n) - n) * width)
            yield out(ids.tobytes())
            at += len(ids) * width + 1
        if keys:
            yield out(_footer(keys, np.concatenate(offsets), np.concatenate(counts)))
        _rest()

    # the text writer writes the bytes of a string as they are, and a line feed after each row
    rows.mapInArrow(run, "block binary").select(F.col("block").cast("string")).write.text(f"{folder}/ids")
    _write_index(spark, folder, docs.schema[key].dataType.simpleString(), width)


# reading shards


def _open(path: str) -> pa.NativeFile:
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _read_footer(path: str, length: int) -> pa.Table:
    with _open(path) as file:
        end = length - _TAIL.size - 1
        size, magic = _TAIL.unpack(file.read_at(_TAIL.size, end))
        if magic != MAGIC:
            raise ValueError(f"{path}: the footer is damaged")
        return pa.ipc.open_stream(file.read_at(size, end - size)).read_all().combine_chunks()


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, shard`` of each file; contents are not read."""
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/ids").where("length > 0")
    return files.select("path", "length", F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("shard"))


def entries(spark: SparkSession, folder: str, key_type: str) -> DataFrame:
    """``key, repeat, shard, offset, n, start`` of every document, from the footers; start: ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = _read_footer(row["path"], row["length"])
                n = np.asarray(table["n"])
                same = np.zeros(len(n), bool)  # as the key before
                kept = table["key"].to_pylist()
                same[1:] = [a == b for a, b in zip(kept, kept[1:], strict=False)]
                place = np.arange(len(n))
                repeat = place - np.maximum.accumulate(np.where(same, 0, place))
                edge = np.array([k == kept[0] or k == kept[-1] for k in kept])
                cells = [table["key"], pa.array(repeat), pa.array(np.full(len(n), row["shard"], np.int32)), table["offset"], table["n"], pa.array(np.cumsum(n) - n), pa.array(edge)]
                yield from pa.table(cells, names=["key", "repeat", "shard", "offset", "n", "local", "edge"]).to_batches(100_000)

    found = _shards(spark, folder).mapInArrow(run, f"key {key_type}, repeat long, shard int, offset long, n long, local long, edge boolean")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    starts = found.groupBy("shard").agg(F.sum("n").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    # rows of a key that began in an earlier shard: only the first and the last key of a shard can have them
    run_of = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.where("edge").groupBy("key", "shard").count().withColumn("more", F.sum("count").over(run_of)).where("more > 0").select(F.col("key").alias("k"), F.col("shard").alias("s"), "more")
    out = found.join(starts, "shard").join(carried, F.col("key").eqNullSafe(F.col("k")) & (F.col("shard") == F.col("s")), "left")
    return out.select("key", (F.col("repeat") + F.coalesce("more", F.lit(0))).alias("repeat"), "shard", "offset", "n", (F.col("base") + F.col("local")).alias("start"))


# the index


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)) ^ b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(n: int) -> int:
    return max(1, -(-2 * n // 64))


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit hashes: levels of bits, two for each key left.

    On each level every key left takes a bit by its hash; keys alone on theirs stay
    there, the others go on.  About three bits a key; a key is found on its first levels.
    """

    LEVELS = 64

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        left, bits, sizes = np.arange(len(a)), [], []
        while len(left):
            if len(sizes) == cls.LEVELS:
                raise ValueError("keys of a bucket share all 128 bits of their hashes")
            words = _words(len(left))
            at = (_mixed(a[left], b[left], len(sizes)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(words)
            left = left[~alone[at]]
        return cls(np.concatenate(bits) if bits else np.zeros(0, "<u8"), sizes)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or the slot of another one for a key that wasn't there."""
        out, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, words in enumerate(self.sizes):
            at = (_mixed(a[left], b[left], level) % np.uint64(words * 64)).astype(np.int64)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            left, base = left[~hit], base + words
        return out


_SLOTS = {"shard": "<i4", "offset": "<i8", "n": "<i8", "start": "<i8"}
_INDEX = "bucket long, keys long, sizes array<int>, bits binary, fingerprint binary, " + ", ".join(f"{c} binary" for c in _SLOTS)


def _hashes(key: Column, repeat: Column) -> tuple[Column, Column]:
    """128 bits of a key and repeat; null is a key of its own."""
    return tuple(F.xxhash64(F.lit(seed), key, key.isNull(), repeat) for seed in (1, 2))


def _fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mixed(b, a, 1 << 20) >> np.uint64(32)).astype("<u4")


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks()).astype(np.int64).view(np.uint64)


def _build(table: pa.Table) -> pa.Table:
    a, b = _unsigned(table["a"]), _unsigned(table["b"])
    perfect = PerfectHash.of(a, b)
    slot = perfect.slots(a, b)

    def dealt(values: np.ndarray, kind: str) -> bytes:
        out = np.zeros(len(values), kind)
        out[slot] = values
        return out.tobytes()

    row = {"bucket": table["bucket"][0].as_py(), "keys": len(a), "sizes": perfect.sizes, "bits": perfect.bits.tobytes(), "fingerprint": dealt(_fingerprint(a, b), "<u4")}
    row |= {c: dealt(np.asarray(table[c]), kind) for c, kind in _SLOTS.items()}
    return pa.Table.from_pylist([row], schema=pa.schema([("bucket", pa.int64()), ("keys", pa.int64()), ("sizes", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("bits", "fingerprint", *_SLOTS)]]))


def _write_index(spark: SparkSession, folder: str, key_type: str, width: int) -> None:
    found = entries(spark, folder, key_type)
    counted = found.agg(F.count("*"), F.sum("n")).first()
    buckets = max(1, -(-counted[0] // BUCKET_KEYS))
    a, b = _hashes(F.col("key"), F.col("repeat"))
    rows = found.select(a.alias("a"), b.alias("b"), *_SLOTS).withColumn("bucket", F.pmod("a", F.lit(buckets)))
    rows.groupBy("bucket").applyInArrow(_build, _INDEX).write.parquet(f"{folder}/index")
    values = {"key_type": key_type, "width": width, "buckets": buckets, "documents": counted[0], "ids": counted[1] or 0}
    spark.range(1).select(*[F.lit(v).alias(c) for c, v in values.items()]).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> dict:
    return spark.read.parquet(f"{folder}/manifest").first().asDict()


def lookup(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, repeat, shard, offset, n, start`` of those keys that are there, each asked key once.

    ``keys`` may have a column ``repeat`` (0, if not).  A key that was never
    written is taken for another one once in four thousand million times, as fingerprints have 32 bits.
    """
    about = manifest(spark, folder)
    repeat = F.col("repeat").cast("long") if "repeat" in keys.columns else F.lit(0).cast("long")
    asked = keys.select(F.col(key).cast(about["key_type"]).alias("key"), repeat.alias("repeat")).distinct()
    a, b = _hashes(F.col("key"), F.col("repeat"))
    asked = asked.select("key", "repeat", a.alias("a"), b.alias("b")).withColumn("bucket", F.pmod("a", F.lit(about["buckets"])))
    # far more keys asked than written: buckets meet them in slices, so that a group stays small
    slices = max(1, -(-asked.count() // max(1, about["documents"])))
    asked = asked.withColumn("slice", F.pmod("b", F.lit(slices)))
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    kind = pa.schema([("shard", pa.int32()), ("offset", pa.int64()), ("n", pa.int64()), ("start", pa.int64())])

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _unsigned(left["a"]), _unsigned(left["b"])
        if not len(right):
            hit, slot, row = np.zeros(len(a), bool), np.zeros(0, int), {c: b"" for c in _SLOTS}
        else:
            row = right.to_pylist()[0]
            slot = PerfectHash(np.frombuffer(row["bits"], "<u8"), row["sizes"]).slots(a, b)
            hit = (slot >= 0) & (np.frombuffer(row["fingerprint"], "<u4")[slot] == _fingerprint(a, b))
        out = left.select(["key", "repeat"]).filter(pa.array(hit))
        for field in kind:
            out = out.append_column(field, pa.array(np.frombuffer(row[field.name], _SLOTS[field.name])[slot[hit] if len(slot) else []], field.type))
        return out

    return asked.groupBy("bucket", "slice").cogroup(index.groupBy("bucket", "slice")).applyInArrow(find, f"key {about['key_type']}, repeat long, shard int, offset long, n long, start long")


def read_ids(spark: SparkSession, folder: str, located: DataFrame) -> DataFrame:
    """``located`` (rows of ``lookup``) with ``ids``: each document's ids, little-endian and unsigned with 32 bits.

    Only the asked ranges are read, neighbours together in reads of some MB.
    """
    bound_batches(spark)
    width = manifest(spark, folder)["width"]
    rows = located.select("key", "repeat", "shard", "offset", "n", "start").join(_shards(spark, folder).select("shard", "path"), "shard")
    rows = rows.repartition("shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset").drop("shard")
    names = ["key", "repeat", "start", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, None
        for batch in batches:
            paths, at, n = batch.column("path").to_pylist(), np.asarray(batch.column("offset")), np.asarray(batch.column("n"))
            stop, i = at + n * width, 0
            while i < len(at):
                j = i + 1  # rows i to j - 1 are read at once
                while j < len(at) and paths[j] == paths[i] and stop[j] - at[i] <= READ_BYTES:
                    j += 1
                if paths[i] != opened:
                    if file:
                        file.close()
                    file, opened = _open(paths[i]), paths[i]
                data = file.read_at(int(stop[j - 1] - at[i]), int(at[i]))
                if len(data) != stop[j - 1] - at[i]:
                    raise ValueError(f"{opened} is cut short")
                ids = [np.frombuffer(data, f"<u{width}", n[r], at[r] - at[i]).astype("<u4").tobytes() for r in range(i, j)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:-1]], pa.array(ids, pa.binary())], names)
                i = j
        if file:
            file.close()

    kind = located.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, repeat long, start long, n long, ids binary")


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every written document, each found by its key through the index: ``key, repeat, start, n, ids``."""
    keys = entries(spark, folder, manifest(spark, folder)["key_type"]).select("key", "repeat")
    return read_ids(spark, folder, lookup(spark, folder, keys, "key"))
