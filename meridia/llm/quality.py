"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The last sum holds all pairwise interactions in time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import bound_batches, tidy

#: Buckets of hashed words; structure statistics come after them.
WORD_BUCKETS = 1 << 12
#: Structure (shares of kinds of bytes and words) and metadata (lengths) of a text, in this order.
DENSE = (
    "log_bytes", "log_words", "mean_word", "long_words", "upper", "digit", "punctuation", "non_ascii", "space",
    "newline", "pipe_words", "tail_punctuation", "upper_words", "distinct_words", "repeated_pairs", "short_lines", "empty",
)
FEATURES = WORD_BUCKETS + len(DENSE)
#: A model is fitted on this many labelled documents at most, those of the smallest hash of doc_id.
TRAIN_ROWS = 8_000

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?"]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: dense features (n, len(DENSE)); and (row, bucket, value) of its hashed words, with L2 norm 1."""
    n = len(offsets) - 1
    hashes, counts = K.words_of(data, offsets, lower=True)
    row = np.repeat(np.arange(n), counts)
    size = np.diff(offsets).astype(float)
    some, words = np.maximum(size, 1), np.maximum(counts, 1).astype(float)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    punct = _PUNCT[data]
    gap = K.SPACE[data]
    last = np.ones(len(data), bool)  # last byte of a word
    last[:-1] = gap[1:]
    last &= ~gap
    twin = np.zeros(len(data), bool)
    twin[1:] = last[1:] & punct[1:] & ~_END[data[1:]]
    lone = np.zeros(len(data), bool)
    lone[1:-1] = (data[1:-1] == 124) & gap[:-2] & gap[2:]
    up_end = np.zeros(len(data), bool)  # a word of capitals, judged at its last letter
    up_end[1:] = upper[1:] & upper[:-1]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)
    lines = _per_row(data == 10, offsets) + 1
    dense = np.stack(
        [
            np.log1p(size) / 10, np.log1p(counts) / 10, size / words / 10, _per_row(~gap, offsets) / words / 10,
            _per_row(upper, offsets) / np.maximum(_per_row(letter, offsets), 1), _per_row((data >= 48) & (data <= 57), offsets) / some,
            _per_row(punct, offsets) / some * 4, _per_row(data >= 128, offsets) / some, _per_row(gap, offsets) / some,
            np.minimum(1, lines / words), _per_row(lone, offsets) / words * 2, _per_row(twin, offsets) / words * 2,
            _per_row(up_end, offsets) / some, distinct / words, np.bincount(row[same], minlength=n) / words * 2,
            lines / some * 20, (counts == 0).astype(float),
        ],
        axis=1,
    )
    dense[counts == 0] = 0
    dense[counts == 0, -1] = 1
    # hashed words: square roots of counts, scaled to length 1
    bucket = (hashes >> np.uint64(52)).astype(np.int64)
    key, count = np.unique(row * WORD_BUCKETS + bucket, return_counts=True)
    at, value = key // WORD_BUCKETS, np.sqrt(count)
    norm = np.sqrt(np.bincount(at, value * value, minlength=n))
    return dense, at, key % WORD_BUCKETS, value / norm[at]


@dataclass
class FactorisationMachine:
    """Bias, linear weights and rank-k factors over ``FEATURES`` inputs; dense inputs are standardised."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def _sums(self, dense, row, bucket, value):
        n, k = len(dense), self.factors.shape[1]
        x = (dense - self.mean) / self.scale
        first = self.bias + x @ self.linear[WORD_BUCKETS:] + np.bincount(row, self.linear[bucket] * value, minlength=n)
        v = self.factors[WORD_BUCKETS:]
        sums, squares = x @ v, (x * x) @ (v * v)
        for f in range(k):
            part = self.factors[bucket, f] * value
            sums[:, f] += np.bincount(row, part, minlength=n)
            squares[:, f] += np.bincount(row, part * part, minlength=n)
        return x, first, sums, squares

    def score(self, dense, row, bucket, value) -> np.ndarray:
        _, first, sums, squares = self._sums(dense, row, bucket, value)
        return 1 / (1 + np.exp(-np.clip(first + 0.5 * (sums * sums - squares).sum(axis=1), -30, 30)))


def _gradients(fm: FactorisationMachine, dense, row, bucket, value, label, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean logistic loss, and ``decay / 2`` times all squared weights, by bias, linear weights and factors."""
    x, first, sums, squares = fm._sums(dense, row, bucket, value)
    p = 1 / (1 + np.exp(-np.clip(first + 0.5 * (sums * sums - squares).sum(axis=1), -30, 30)))
    g = (p - label) / len(label)
    linear, factors = decay * fm.linear, decay * fm.factors
    np.add.at(linear, bucket, g[row] * value)
    linear[WORD_BUCKETS:] += x.T @ g
    # d/dv_if = x_i (sum_j v_jf x_j) - v_if x_i^2
    np.add.at(factors, bucket, (g[row] * value)[:, None] * (sums[row] - fm.factors[bucket] * value[:, None]))
    own = fm.factors[WORD_BUCKETS:]
    factors[WORD_BUCKETS:] += x.T @ (g[:, None] * sums) - own * ((x * x).T @ g)[:, None]
    return np.array([g.sum()]), linear, factors


def fit(dense, row, bucket, value, label, rank: int = 6, epochs: int = 25, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
    """Logistic loss, mini-batches, Adam.  Without rows of both labels the model is a constant."""
    rng = np.random.default_rng(seed)
    n = len(dense)
    mean, scale = (dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)) if n else (np.zeros(len(DENSE)), np.ones(len(DENSE)))
    share = (label.sum() + 1) / (n + 2)
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(FEATURES), np.zeros((FEATURES, rank)), mean, scale)
    if not 0 < label.sum() < n:
        return fm
    fm.factors = rng.normal(0, 0.02, (FEATURES, rank))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), fm.linear, fm.factors)]
    begin = np.searchsorted(row, np.arange(n + 1))
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for i in range(0, n, batch):
            rows = shuffled[i : i + batch]
            take = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows])
            b, v = bucket[take], value[take]
            gradients = _gradients(fm, dense[rows], local, b, v, label[rows], decay)
            step += 1
            for k, (grad, (m, s)) in enumerate(zip(gradients, moments, strict=True)):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                if k == 0:
                    fm.bias -= float(move[0])
                elif k == 1:
                    fm.linear -= move
                else:
                    fm.factors -= move
    return fm


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on labelled documents whose ``crc32(doc_id) mod 4`` is not 2, a bounded sample.

    ``labels`` needs ``doc_id`` and ``quality`` (0 or 1; others and null are
    ignored).  Of a repeated doc_id one row counts.
    """
    chosen = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` rows of two numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("text"))
            for i, j in K.row_blocks(offsets):
                dense, row, bucket, value = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                count = np.bincount(row, minlength=j - i)
                at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                wide = np.arange(0, len(dense) * len(DENSE) + 1, len(DENSE), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("quality").slice(i, j - i).cast(pa.int32()),
                        pa.ListArray.from_arrays(pa.array(wide), pa.array(dense.ravel())),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.float32))),
                    ],
                    ["doc_id", "quality", "dense", "bucket", "value"],
                )

    found = sample.mapInArrow(extract, "doc_id long, quality int, dense array<double>, bucket array<int>, value array<float>")
    table = found.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")  # bounded: `rows` short lists
    if not len(table):
        return fit(np.zeros((0, len(DENSE))), *[np.zeros(0, np.int64)] * 2, np.zeros(0), np.zeros(0))
    flat = {c: np.concatenate([np.asarray(chunk.flatten()) for chunk in table.column(c).chunks]) for c in ("dense", "bucket", "value")}
    count = np.concatenate([np.diff(np.asarray(chunk.offsets)) for chunk in table.column("bucket").chunks])
    return fit(flat["dense"].reshape(-1, len(DENSE)), np.repeat(np.arange(len(table)), count), flat["bucket"].astype(np.int64), flat["value"].astype(float), np.asarray(table.column("quality")).astype(float))


def held_out(doc_id):
    """``crc32(doc_id as text) mod 4 = 2``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def score_documents(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """Adds ``score`` (double, 0 to 1): how likely the text has quality label 1.

    Only the text is read; all columns are kept (a ``score`` column is replaced).
    Null counts as the empty text, which is scored as well.  Repeated rows give
    the same score each, an empty table an empty one; texts are read in blocks.
    """
    docs = docs.drop("score")
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("text"))
            for i, j in K.row_blocks(offsets):
                score = shipped.value.score(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])

    return docs.mapInArrow(tidy(run), docs.withColumn("score", F.lit(0.0)).schema)
