"""Fuzzy line dedup: MinHash of character shingles, bands, exact Jaccard, union-find.

Texts are read three times and moved only where the lines to compare can't be
broadcast: for the hashes of lines, for the bands, and for the text of lines that
share a band.  Band keys travel as packed records, and a bucket that one block of
texts already shares sends a single record, so a hot bucket is no hot task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import linked_components
from .scratch import bound_batches, drop, materialize, tidy

SHINGLE_CHARS = 8
#: 12 bands of 4 bins: of lines with a similarity of 0.8 they miss 1 in 600 pairs, of 0.9 fewer than 1 in 100,000.
BINS, BANDS, WIDTH = 64, 12, 4
#: Bytes of text worked on together; a text that is longer is a block of its own.
BLOCK = 1 << 17
#: Band records that a task gathers before it sends them, and those of one partition of the exchange.
FLUSH_RECORDS, PART_RECORDS = 1 << 18, 1 << 19
#: Pairs whose sets are compared together: the number of a pair and 54 bits of a hash make one key.
PAIRS = 1 << 10
#: Lists of lines are broadcast where they take so many bytes or fewer.
BROADCAST_BYTES = 32 << 20
_U = np.uint64


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; white space around it is left out (a blank line is empty)."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    # a row's first line begins with the row, the others after its breaks
    starts = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    # a line ends before its break, a row's last line with the row
    ends = np.concatenate([breaks, offsets[1:]])
    owner = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, np.arange(len(offsets) - 1)])
    ends = ends[np.lexsort((ends, owner))]
    for _ in range(8):  # most lines have no more white space than that around them
        a = np.flatnonzero(starts < ends)
        a = a[K.SPACE[data[starts[a]]]]
        starts[a] += 1
        b = np.flatnonzero(starts < ends)
        b = b[K.SPACE[data[ends[b] - 1]]]
        ends[b] -= 1
        if not len(a) and not len(b):
            return starts, ends, row
    full = np.flatnonzero(~K.SPACE[data])
    a, b = np.searchsorted(full, starts), np.searchsorted(full, ends)
    some, at = b > a, np.append(full, 0)
    return np.where(some, at[np.minimum(a, len(full))], starts), np.where(some, at[np.maximum(b, 1) - 1] + 1, starts), row


def _blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.string_buffers(batch.column(column))
    for i, j in K.row_blocks(offsets, BLOCK):
        yield i, j, K.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """A number for each character (code point), and where each begins (None: one byte each)."""
    if not (data & 0x80).any():
        return data, None
    at = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(at, len(data)))
    value = data[at].astype(_U)
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        value[more] = value[more] << _U(8) | data[at[more] + k]
    return value, at


def _shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each character shingle of each span, in order, with the span of each; not distinct yet.

    A character is a code point; a span of fewer than eight is one shingle.
    """
    value, at = _characters(data)
    first, last = (starts, ends) if at is None else (np.searchsorted(at, starts), np.searchsorted(at, ends))
    h, width = value.astype(_U) * K.MULT[0] + K.MULT[1], 1
    while width < SHINGLE_CHARS:  # windows of twice the width from two that touch
        h = h[: max(0, len(h) - width)] * K.MULT[1 + width] + h[width:]
        width *= 2
    size = last - first
    count = np.where(size > 0, np.maximum(1, size - SHINGLE_CHARS + 1), 0)
    span = np.repeat(np.arange(len(starts)), count)
    at = np.repeat(first - np.cumsum(count) + count, count)
    at += np.arange(len(at))
    h ^= h >> _U(29)
    h *= K.MULT[2]
    h ^= h >> _U(32)
    out = h.take(at, mode="clip") if len(h) else np.zeros(len(at), _U)  # clipped: lines shorter than a shingle
    short = np.flatnonzero((size > 0) & (size < SHINGLE_CHARS))
    if len(short):
        out[(np.cumsum(count) - count)[short]] = K.mix(K.span_hashes(data, starts[short], ends[short]) ^ K.MULT[3])
    return out, span


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line that is not blank: document, number, two hashes."""
    for batch in batches:
        for i, j, data, offsets in _blocks(batch):
            starts, ends, row = _lines(data, offsets)
            first = np.searchsorted(row, np.arange(j - i))
            number = np.arange(len(row)) - first[row]
            some = ends > starts
            a = K.span_hashes(data, starts[some], ends[some])
            b = K.span_hashes(data ^ 0x5A, starts[some], ends[some])
            ids = np.asarray(batch.column("doc_id").slice(i, j - i))
            columns = [ids[row[some]], number[some].astype(np.int32), a.view(np.int64), b.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "line", "a", "b"])


_EXCHANGE = "to int, part int, kind int, buckets binary, nodes binary"
#: Kinds of rows: a bucket of one node in a flush; a bucket that a flush shares; the members of such buckets.
_ALONE, _SHARED, _MEMBERS = 0, 1, 2


def _bands(parts: int) -> Callable:
    """Texts: packed records of the bands of their lines, dealt by the bucket."""

    def send(nodes: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes, once = np.unique(nodes, return_index=True)
        part = (keys[once] >> _U(32)) % _U(parts)
        bucket = (part << _U(32) | keys[once] & _U(0xFFFFFFFF)).ravel()
        order = np.argsort(bucket)
        bucket, node = bucket[order], np.repeat(nodes, BANDS)[order]
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(bucket)))
        alone, lead = np.repeat(size == 1, size), new & np.repeat(size > 1, size)
        rows = []
        for kind, pick in ((_ALONE, alone), (_SHARED, lead)):
            b, n = bucket[pick], node[pick]
            at = (b >> _U(32)).astype(np.int64)
            cut = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)]), len(at))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                sent = n[i:j].tobytes() if kind == _ALONE else b""
                rows.append((int(at[i]), int(at[i]), kind, b[i:j].astype(np.uint32).tobytes(), sent))
        if not alone.all():
            b, n = bucket[~alone], node[~alone]
            rows.append((int(n[0] % _U(parts)), 0, _MEMBERS, b.tobytes(), n.tobytes()))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["to", "part", "kind", "buckets", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, held, count = K.probe_table(BINS), [], 0
        for batch in batches:
            for _, _, data, offsets in _blocks(batch):
                starts, ends, _ = _lines(data, offsets)
                some = ends > starts
                a, once = np.unique(K.span_hashes(data, starts[some], ends[some]), return_index=True)
                if not len(a):
                    continue
                values, span = _shingles(data, starts[some][once], ends[some][once])
                held.append((a, K.band_keys(K.one_permutation(values, span, len(a), BINS, probes), BANDS, WIDTH)))
                count += len(a) * BANDS
                if count >= FLUSH_RECORDS:
                    yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, count = [], 0
        if held:
            yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the exchange: the members ``(bucket, a)`` of buckets with two nodes or more.

    Of each bucket one record is kept: its only node so far, or that it is
    shared; so memory doesn't depend on how many nodes a bucket has.
    """
    known = (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, bool))  # bucket, node, shared; by bucket
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out(bucket: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(node.view(np.int64))], ["bucket", "a"])

    def settle() -> pa.RecordBatch:
        nonlocal known
        bucket, node, shared = (np.concatenate(x) for x in zip(known, *held, strict=True))
        old = np.arange(len(bucket)) < len(known[0])
        held.clear()
        order = np.argsort(bucket, kind="stable")
        bucket, node, shared, old = bucket[order], node[order], shared[order], old[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        size = np.diff(np.append(first, len(bucket)))
        named = ~shared  # a shared mark names no node
        low = np.minimum.reduceat(np.where(named, node, ~_U(0)), first)
        high = np.maximum.reduceat(np.where(named, node, _U(0)), first)
        now = np.logical_or.reduceat(shared, first) | ((low < high) & (low != ~_U(0)))
        was = np.logical_or.reduceat(shared & old, first)
        emit = np.repeat(now, size) & named
        known = (bucket[first], np.where(now, _U(0), low), now)
        assert not (emit & old & np.repeat(was, size)).any()
        return out(bucket[emit], node[emit])

    count = 0
    for batch in batches:
        for part, kind, buckets, nodes in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "buckets", "nodes")), strict=True):
            if kind == _MEMBERS:
                yield out(np.frombuffer(buckets, _U), np.frombuffer(nodes, _U))
                continue
            bucket = np.frombuffer(buckets, np.uint32).astype(_U) | _U(part) << _U(32)
            held.append((bucket, np.frombuffer(nodes, _U) if kind == _ALONE else np.zeros(len(bucket), _U), np.full(len(bucket), kind == _SHARED)))
            count += len(bucket)
            if count >= FLUSH_RECORDS:
                yield settle()
                count = 0
    if held:
        yield settle()


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(text, hashes, nodes)``: the lines of these hashes, trimmed and lower-cased."""
    for batch in batches:
        flat = {c: np.asarray(batch.column(c).flatten()) for c in ("hashes", "nodes")}
        at = np.asarray(batch.column("hashes").offsets)
        at = at - at[0]
        for i, j, data, offsets in _blocks(batch):
            starts, ends, row = _lines(data, offsets)
            order = np.lexsort((K.span_hashes(data, starts, ends).view(np.int64), row))
            starts, ends, row = starts[order], ends[order], row[order]
            found = K.span_hashes(data, starts, ends).view(np.int64)
            cut = np.searchsorted(row, np.arange(j - i + 1))
            nodes, bodies = [], []
            for r in range(i, j):
                own = found[cut[r - i] : cut[r - i + 1]]
                wanted = flat["hashes"][at[r] : at[r + 1]]
                place = np.searchsorted(own, wanted)
                there = np.flatnonzero(place < len(own))
                there = there[own[place[there]] == wanted[there]]
                nodes += flat["nodes"][at[r] : at[r + 1]][there].tolist()
                lines = (place[there] + cut[r - i]).tolist()
                bodies += [data[starts[k] : ends[k]].tobytes() for k in lines]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(bodies, pa.binary())], ["node", "body"])


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct shingles of each row (at most 1024), as row << 54 | hash."""
    values, span = _shingles(data, offsets[:-1], offsets[1:])
    keys = np.sort(span.astype(_U) << _U(54) | values >> _U(10))
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(a, b, x, y)`` with the lines x and y: the sizes of their sets and of the intersection."""
    for batch in batches:
        (x, x_at), (y, y_at) = (K.string_buffers(batch.column(c)) for c in "xy")
        both = x_at + y_at
        i = 0
        while i < len(batch):
            j = int(np.searchsorted(both, both[i] + BLOCK, side="right")) - 1
            j = min(len(batch), i + PAIRS, max(i + 1, j))
            one, two = (_keys(d[at[i] : at[j]], at[i : j + 1] - at[i]) for d, at in ((x, x_at), (y, y_at)))
            met = np.intersect1d(one, two, assume_unique=True)
            counts = [np.bincount((k >> _U(54)).astype(np.int64), minlength=j - i) for k in (one, two, met)]
            yield pa.RecordBatch.from_arrays([batch.column("a").slice(i, j - i), batch.column("b").slice(i, j - i), *(pa.array(c.astype(np.int32)) for c in counts)], ["a", "b", "na", "nb", "common"])
            i = j


def _measure(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "x", "y").mapInArrow(tidy(_measured), "a long, b long, na int, nb int, common int")


def _sets(rows: DataFrame) -> DataFrame:
    """Replaces ``body`` by ``x``, the distinct hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("body"))
            for i, j in K.row_blocks(offsets, BLOCK):
                values, span = K.distinct_by_row(*_shingles(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]))
                lists = K.int64_lists(values, np.bincount(span, minlength=j - i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in rest), lists], [*rest, "x"])

    rest = [c for c in rows.columns if c != "body"]
    return rows.mapInArrow(tidy(run), rows.select(*rest, F.array().cast("array<long>").alias("x")).schema)


_DOC, _GONE = "__line_dedup_doc", "__line_dedup_gone"


def _without(text: Column, gone: Column) -> Column:
    """A text without the lines of these numbers; a text of a null list is left as it is."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # in a struct of its own, so that the text is split once and not for each line
    joined = F.transform(F.array(F.struct(lines.alias("lines"), kept.alias("kept"))), lambda s: F.array_join(F.transform(s["kept"], lambda i: F.get(s["lines"], i)), "\n"))
    return F.when(gone.isNull() | text.isNull(), text).otherwise(joined[0])


def _small(lists: DataFrame, column: str) -> DataFrame:
    """Hint a broadcast of (written) lists by document after summing their bytes; beyond the bound Spark shuffles."""
    numbers, rows = lists.agg(F.sum(F.size(column)), F.count("*")).first()
    return F.broadcast(lists) if (numbers or 0) * 20 + rows * 120 <= BROADCAST_BYTES else lists


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Keep one line of each group of alike lines, over all documents.

    Lines end at ``\\n``; they are compared without the white space around them
    and with A-Z lower-cased.  Two lines are linked where the sets of their
    eight-character shingles have ``100 * intersection >= percent * union``
    (shorter lines are one shingle); of each component the first line stays, by
    doc_id and place.  Blank lines are layout: never linked, never removed.

    Returns all rows and columns of ``docs`` with ``text`` rebuilt, and
    ``n_lines``, ``n_removed`` (replaced where they exist).  A null text stays
    null, an empty one empty, with no lines.  A null doc_id: its lines take no
    part.  Rows that share a doc_id are one document and should be alike; each is
    returned, and the same line numbers go.  A text may be of any length, but has
    to fit in memory some sixty times.  An empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "n_removed")
    bound_batches(docs.sparkSession)
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    lines = materialize(typed.mapInArrow(tidy(_scan), "doc_id long, line int, a long, b long"))
    # equal lines are one node, whose number is unique by construction and fixed once written
    spots = lines.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    spots = materialize(spots.withColumn("node", F.monotonically_increasing_id()))

    tasks = max(1, -(-lines.count() * BANDS // PART_RECORDS))
    dealt = typed.select("text").mapInArrow(tidy(_bands(4 * tasks)), _EXCHANGE).repartition(tasks, "to")
    shared = materialize(dealt.mapInArrow(tidy(_members), "bucket long, a long"))
    near = materialize(spots.join(shared.select("a").distinct(), "a").select("a", "node", "doc_id"))
    members = materialize(shared.join(near.select("a", "node"), "a").select("bucket", "node").distinct())
    lists = near.groupBy("doc_id").agg(F.collect_list(F.struct("a", "node")).alias("l"))
    lists = materialize(lists.select(F.col("doc_id").alias(_DOC), F.col("l.a").alias("hashes"), F.col("l.node").alias("nodes")))
    texts = typed.join(_small(lists, "hashes"), F.col("doc_id") == F.col(_DOC)).select("text", "hashes", "nodes")
    bodies = materialize(texts.mapInArrow(tidy(_picked), "node long, body binary").dropDuplicates(["node"]))
    parts = linked_components(members, bodies, percent, _measure, _sets)

    # a component keeps the first of its lines, by doc_id and place
    grouped = spots.join(parts, "node", "left").where("component is not null or n > 1")
    many = materialize(grouped.select("a", "b", F.coalesce("component", "node").alias("component")))
    alike = materialize(lines.join(many, ["a", "b"]).select("component", "doc_id", "line"))
    first = alike.groupBy("component").agg(F.min("doc_id").alias("doc_id"))
    first = alike.join(first, ["component", "doc_id"]).groupBy("component", "doc_id").agg(F.min("line").alias("line"))
    extra = alike.join(first, ["component", "doc_id", "line"], "left_anti")
    gone = materialize(extra.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias(_GONE)).withColumnRenamed("doc_id", _DOC))
    for used in (lines, spots, shared, near, members, lists, bodies, parts, many, alike):
        drop(used)
    out = docs.join(_small(gone, _GONE), F.col("doc_id") == F.col(_DOC), "left").drop(_DOC)
    text, lost = F.col("text"), F.col(_GONE)
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    n_lines = F.when(F.octet_length(text) > 0, breaks + 1).otherwise(0).cast("long")
    rest = [c for c in docs.columns if c != "text"]
    return out.select(*rest, _without(text, lost).alias("text"), n_lines.alias("n_lines"), F.when(lost.isNull(), 0).otherwise(F.size(lost)).cast("long").alias("n_removed"))
