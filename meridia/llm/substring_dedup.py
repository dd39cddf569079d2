"""Substring dedup: window starts grouped by the smallest k-gram of their window, sorted to the window's depth.

A passage of ``window`` words that occurs twice holds the same anchor in both
places: the k-gram with the smallest hash in it.  So suffixes are partitioned by
the k words at their anchor; consecutive window starts with one anchor travel
together.  Groups of one document have no inner node and are left out.  In the
others, prefix doubling sorts the suffixes of the group to a depth of ``window``
words; suffixes of equal rank hang below one inner node of that depth, which
is a repeat.  A group too large for memory takes the longest prefix instead, all
``window`` words: then each group is a single node, and its smallest document
is a distributed minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import broadcast_if_small
from .scratch import drop, materialize, release_shuffles

ANCHOR_WORDS = 20
#: A prefix group of more suffix runs than this is split by the longest prefix.
GROUP_RUNS = 32_768
#: Runs sorted together; whole groups only.
CHUNK_RUNS = 4096
#: A list of positions or spans is broadcast up to this many in all.
BROADCAST_ITEMS = 4_000_000
_POSITION = np.uint64((1 << 28) - 1)


def _anchors(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor of each, and the k-gram hashes, as positions in ``hashes``.

    The anchor is the leftmost k-gram of the smallest hash in the window, so it
    depends on the words of the window only.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = K.combine(hashes, ANCHOR_WORDS)
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, span = window - ANCHOR_WORDS + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    starts = np.flatnonzero(row[:n] == row[window - 1 :])
    return starts, (least[starts] & _POSITION).astype(np.int64), grams


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.string_buffers(batch.column("text"))
    for i, j in K.row_blocks(offsets):
        yield i, j, *K.words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=False)


def _starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _scan(window: int) -> Callable:
    """Rows ``(doc_id, text)``: a digest of the word sequence, anchor keys and their word positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, counts in _blocks(batch):
                _, anchor, grams = _anchors(hashes, counts, window)
                anchor = np.unique(anchor)
                first = _starts_of(counts)
                row = np.searchsorted(first + counts, anchor, side="right")
                per = np.bincount(row, minlength=j - i)
                order = np.arange(len(hashes)) - np.repeat(first, counts)
                up = K.powers(int(counts.max(initial=0)) + 1)[0]
                a = K.row_sums(hashes * up[order], counts)
                b = K.row_sums(K.mix(hashes ^ K.MULT[7]) * up[order], counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(counts),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        K.int64_lists(grams[anchor], per),
                        K.int64_lists(anchor - first[row], per),
                    ],
                    ["doc_id", "n_words", "seq_a", "seq_b", "keys", "at"],
                )

    return run


def _list(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    column = batch.column(name)
    return np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))


def _runs(window: int) -> Callable:
    """Rows ``(doc_id, text, cold, hot)``: a run of window starts for each listed anchor.

    ``cold`` runs carry their words, ``hot`` ones a hash of each window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = {name: _list(batch, name) for name in ("cold", "hot")}
            for i, j, hashes, counts in _blocks(batch):
                starts, anchor, grams = _anchors(hashes, counts, window)
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                lead = np.flatnonzero(new)
                size = np.diff(np.append(lead, len(anchor)))
                ids = np.asarray(batch.column("doc_id").slice(i, j - i))
                first = _starts_of(counts)
                for name, (values, lengths) in picked.items():
                    before = int(lengths[:i].sum())
                    wanted = values[before : before + int(lengths[i:j].sum())] + np.repeat(first, lengths[i:j])
                    keep = np.isin(anchor[lead], wanted)
                    at, n = starts[lead[keep]], size[keep]
                    if not len(at):
                        continue
                    row = np.searchsorted(first + counts, at, side="right")
                    if name == "cold":
                        payload, per = hashes, n + window - 1
                    else:
                        payload, per = K.combine(hashes, window), n
                    take = np.repeat(at - np.cumsum(per) + per, per) + np.arange(int(per.sum()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams[anchor[lead[keep]]].view(np.int64)),
                            pa.array(np.full(len(at), name == "hot")),
                            pa.array(ids[row]),
                            pa.array(at - first[row]),
                            K.int64_lists(payload[take], per),
                        ],
                        ["key", "hot", "doc_id", "start", "words"],
                    )

    return run


def _subtrees(window: int) -> Callable:
    """Runs sorted by key: spans ``(doc_id, first, last)`` of window starts that a smaller document also has."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        words = table.column("words").combine_chunks()
        flat = np.asarray(words.flatten())
        per = np.diff(np.asarray(words.offsets))
        run_key, run_doc, run_start = (np.asarray(table.column(c).combine_chunks()) for c in ("key", "doc_id", "start"))
        first = np.cumsum(per) - per
        n = per - window + 1
        leaf = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        # prefix doubling over the words of the chunk: equal ranks are equal prefixes of that depth
        rank = np.unique(flat, return_inverse=True)[1].astype(np.int64)
        depth = 1
        while depth < window:
            step = min(depth, window - depth)
            pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            depth += step
        # inner nodes: leaves of one group (key) and one rank
        node, run = rank[leaf], np.repeat(np.arange(len(per)), n)
        doc = run_doc[run]
        order = np.lexsort((doc, node, run_key[run]))
        new = np.ones(len(order), bool)
        new[1:] = (node[order][1:] != node[order][:-1]) | (run_key[run[order]][1:] != run_key[run[order]][:-1])
        least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        repeat = np.zeros(len(order), bool)
        repeat[order] = doc[order] > least
        # neighbouring repeats of a run become one span
        at = np.flatnonzero(repeat)
        if not len(at):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["doc_id", "first", "last"])
        start = run_start[run] + leaf - first[run]
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]])
        head = at[cut]
        tail = at[np.append(np.flatnonzero(cut)[1:] - 1, len(at) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(start[head]), pa.array(start[tail])], ["doc_id", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            i = 0
            while i < len(batch):
                piece = batch.slice(i, CHUNK_RUNS)
                i += len(piece)
                held.append(piece)
                rows += len(piece)
                if rows >= CHUNK_RUNS:
                    table = pa.Table.from_batches(held)
                    keys = np.asarray(table.column("key"))
                    whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                    if whole:
                        yield solve(table.slice(0, whole))
                        held, rows = table.slice(whole).to_batches(), len(table) - whole
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def _cut(window: int) -> Callable:
    """Rows ``(doc_id, text, spans)``: how many words go, and the others joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("text"))
            spans = batch.column("spans")
            for i, j in K.row_blocks(offsets):
                total, gone, kept = [], [], []
                for k in range(i, j):
                    words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    total.append(len(words))
                    ranges = spans[k].as_py() if spans[k].is_valid else None
                    if ranges:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for r in ranges:
                            edge[r["first"]] += 1
                            edge[min(len(words), r["last"] + window)] -= 1
                        keep = np.cumsum(edge)[:-1] == 0
                        words = list(compress(words, keep.tolist()))
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return run


def _bounded(lists: DataFrame, total: int) -> DataFrame:
    """Broadcast lists by document where all of them together are few, or else shuffle."""
    return F.broadcast(lists) if total <= BROADCAST_ITEMS else lists


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """``(doc_id, spans)``: inclusive ranges ``first..last`` of window starts that a smaller doc_id also has."""
    if window < 2 * ANCHOR_WORDS:
        raise ValueError(f"window must be at least {2 * ANCHOR_WORDS} words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    scan = materialize(docs.mapInArrow(_scan(window), "doc_id long, n_words long, seq_a long, seq_b long, keys array<long>, at array<long>").where(F.col("n_words") >= window))
    # copies of a whole word sequence: only the smallest doc_id stays in the trees
    same = ["seq_a", "seq_b", "n_words"]
    classes = materialize(scan.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    copied = classes.where("n > 1").drop("n")
    whole = scan.drop("keys", "at").join(copied, same).where("doc_id > least").select("doc_id", F.lit(0).cast("long").alias("first"), (F.col("n_words") - window).alias("last"))
    whole = materialize(whole)
    originals = scan.join(broadcast_if_small(whole.select("doc_id")), "doc_id", "left_anti")
    suffixes = originals.select("doc_id", F.explode(F.arrays_zip("keys", "at")).alias("s")).select("doc_id", F.col("s.keys").alias("key"), F.col("s.at").alias("at"))
    # prefix groups with suffixes of two documents or more
    groups = suffixes.groupBy("key").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q"), F.count("*").alias("runs")).where("p <> q")
    groups = materialize(groups.select("key", (F.col("runs") > GROUP_RUNS).alias("hot")))
    places = suffixes.join(broadcast_if_small(groups), "key").groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("at"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("at"))).alias("hot")
    )
    places = materialize(places)
    release_shuffles(docs.sparkSession)
    total = places.agg(F.sum(F.size("cold") + F.size("hot"))).first()[0] or 0
    runs = docs.join(_bounded(places, total), "doc_id").mapInArrow(_runs(window), "key long, hot boolean, doc_id long, start long, words array<long>")
    runs = materialize(runs)
    cold = runs.where("not hot").select("key", "doc_id", "start", "words").repartition("key").sortWithinPartitions("key")
    spans = cold.mapInArrow(_subtrees(window), "doc_id long, first long, last long")
    hot = runs.where("hot").select("key", "doc_id", "start", F.posexplode("words").alias("i", "prefix"))
    nodes = hot.groupBy("key", "prefix").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    split = hot.join(nodes, ["key", "prefix"]).where("doc_id > least").select("doc_id", (F.col("start") + F.col("i")).alias("first")).withColumn("last", F.col("first"))
    out = materialize(spans.union(split).union(whole).groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    for used in (scan, classes, whole, groups, places, runs):
        drop(used)
    release_shuffles(docs.sparkSession)
    return out


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Cut every passage of ``window`` words or more that an earlier document also has.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored.
    Words are runs of anything but ASCII white space, unchanged.  A window is
    ``window`` consecutive words of a document; a word goes where it lies in a
    window whose words also occur in a document with a smaller doc_id.  Windows
    are judged on the input.

    Returns for every input row ``doc_id, n_words, n_removed, kept_text`` (kept
    words joined by one space).

    Null text: no words, ``kept_text`` empty.  Null doc_id: neither cut nor a
    source.  Rows that share a doc_id are one document and should be alike;
    each is returned.  Texts shorter than the window stay whole.  An empty table
    gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs, window)
    total = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    return docs.join(_bounded(spans, total), "doc_id", "left").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")
