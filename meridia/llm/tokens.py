"""Token counts under a unigram vocabulary, with one trie for all pre-tokens.

The trie holds the distinct pre-tokens.  Each node keeps the forward score of
its prefix, the best sum of piece scores over its segmentations, so a prefix
that pre-tokens share is scored once; a terminal node keeps the piece count.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Kept, bound_batches

#: The trie starts anew beyond this many nodes; long pre-tokens are scored without staying in it.
MAX_NODES, MAX_PIECE_BYTES = 1_200_000, 256
_LONG_TEXT = 1 << 22


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities of pieces from the ranks of a vocabulary, by Zipf's law."""
    total = math.log(sum(1 / (rank + 1) for rank in ranks.values()))
    return {piece: -math.log(rank + 1) - total for piece, rank in ranks.items()}


class TrieScorer:
    """Best segmentations of pre-tokens: highest score, then fewest pieces."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.best = [0.0]  # forward score of the node's prefix
        self.count = [0]  # pieces of that segmentation
        self.terminal: dict[str, int] = {}

    def _extend(self, prefix: bytes, path: list[int]) -> tuple[float, int]:
        best, count = -math.inf, 0
        get, n = self.scores.get, len(prefix)
        for i in range(max(0, n - self.longest), n):
            score = get(prefix[i:])
            if score is not None:
                total = self.best[path[i]] + score
                pieces = self.count[path[i]] + 1
                if total > best or (total == best and pieces < count):
                    best, count = total, pieces
        return best, count

    def pieces(self, token: str) -> int:
        """Number of pieces of one pre-token."""
        known = self.terminal.get(token)
        if known is not None:
            return known
        data = token.encode("utf-8", "surrogatepass")
        if len(data) > MAX_PIECE_BYTES:
            return self._plain(data)
        if len(self.best) > MAX_NODES:
            self.reset()
        node, path = 0, [0]
        for i, byte in enumerate(data):
            key = node << 8 | byte
            node = self.child.get(key, 0)
            if not node:
                best, count = self._extend(data[: i + 1], path)
                node = self.child[key] = len(self.best)
                self.best.append(best)
                self.count.append(count)
            path.append(node)
        self.terminal[token] = self.count[node]
        return self.count[node]

    def _plain(self, data: bytes) -> int:
        best, count = [0.0], [0]
        for n in range(1, len(data) + 1):
            top, pieces = -math.inf, 0
            for i in range(max(0, n - self.longest), n):
                score = self.scores.get(data[i:n])
                if score is not None and (best[i] + score > top or (best[i] + score == top and count[i] + 1 < pieces)):
                    top, pieces = best[i] + score, count[i] + 1
            best.append(top)
            count.append(pieces)
        return count[-1]


_kept = Kept()


def _scorer(key: str, scores: dict[bytes, float], pattern: str) -> tuple:
    """This worker's trie and pattern; a function of the module, as what a task's own function refers to is copied for each task."""
    import regex

    return _kept.take(key, lambda: (TrieScorer(scores), regex.compile(pattern)))


def _task_over() -> None:
    _kept.rest()


def count_tokens(docs: DataFrame, scores: dict[bytes, float], pattern: str) -> DataFrame:
    """Adds ``n_pretokens`` and ``n_tokens`` (long): matches of ``pattern``, and their unigram pieces.

    ``docs`` needs ``text``; its other columns are kept (the two are replaced).
    Null and empty texts count 0, repeated rows count each, an empty table gives
    an empty one; a very long text is read match by match.  ``scores`` must have
    every single byte, so every text has a segmentation.
    """
    if any(bytes([b]) not in scores for b in range(256)):
        raise ValueError("a byte-level vocabulary has every single byte")
    docs = docs.drop("n_pretokens", "n_tokens")
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((scores, pattern))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, compiled = _scorer(key, *shipped.value)
        for batch in batches:
            _, offsets = K.string_buffers(batch.column("text"))
            for i, j in K.row_blocks(offsets):
                part = batch.slice(i, j - i)
                tokens, pieces = [], []
                for text in part.column("text").to_pylist():
                    found = compiled.findall(text or "") if len(text or "") <= _LONG_TEXT else (m[0] for m in compiled.finditer(text))
                    n = total = 0
                    get = scorer.terminal.get
                    for token in found:
                        n += 1
                        known = get(token)
                        if known is None:
                            known = scorer.pieces(token)
                            get = scorer.terminal.get
                        total += known
                    tokens.append(n)
                    pieces.append(total)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens, pa.int64()), pa.array(pieces, pa.int64())], [*part.schema.names, "n_pretokens", "n_tokens"])
        _task_over()

    return docs.mapInArrow(run, docs.withColumn("n_pretokens", F.lit(0).cast("long")).withColumn("n_tokens", F.lit(0).cast("long")).schema)
