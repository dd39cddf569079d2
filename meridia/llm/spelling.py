"""Spelling variants: words one edit apart, by merging the light subtrees of a trie.

Two words are near if they differ by one code point inserted, deleted or
replaced.  They part at one node of a trie of all words.  At each node
the largest child is heavy (the paths of heavy children split the trie), and the
words of the light children are merged, small into large, into what the node holds
already: once with their next character replaced by any (light ones
meet each other, or a word of the heavy child) and once with it skipped (they meet a
word of the node), or with the heavy child's character put before it.  Terminals
that coincide are one edit apart.  A word is light at log2(n) nodes at most.

Spark deals the words out so that a trie fits a task: with ``m`` code points in the
shorter one, near words share their first ``m // 2`` or else their last ``m - m // 2``
code points, and each pair is met on one side, for one ``m``, at one node.  Where
too many words share such a prefix, the trie's next level is done by a shuffle:
words meet by what is left after one character, and the prefix grows by one.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, materialize

#: Words of a trie that one task holds at once; groups beyond it are split further.
GROUP_WORDS = 50_000
#: Entries of a task's table of counts; beyond, it hands them on and begins anew.
HELD = 300_000
#: Bytes of Latin-1 text to letters, A to Z in lower case; all others separate words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_KEYS = ["side", "size", "key"]
_PART = "word string, near long, rank long, form string"


# words


def count_words(docs: DataFrame, min_length: int = 7, drop_every: int = 0) -> DataFrame:
    """``word, n`` of the runs of ``[A-Za-z\\u00C0-\\u00FF]`` in ``doc_id, text``, in parts to be added up; A to Z in lower case.

    ``drop_every`` makes misspellings: a run loses code point ``h % length`` where that divides
    ``h``, the crc32 of ``<doc_id>:<run>``.  Words shorter than ``min_length`` go.  A
    null text has none, a null doc_id is written as nothing.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.table([pa.array([w.decode("latin-1") for w in held]), pa.array(held.values(), pa.int64())], names=["word", "n"]).to_batches(50_000)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(text.encode("latin-1", "replace").translate(_FOLD).split()).items():
                    if len(word) < min_length:
                        continue
                    if drop_every:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    held[word] += n
            if len(held) > HELD:
                yield from out()
                held.clear()
        if held:
            yield from out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text is not null")
    return rows.mapInArrow(run, "word string, n long")


# near words of a group


class Near:
    """Counts near words, and keeps the most frequent one of each word (ties: the smaller)."""

    def __init__(self, counts: dict[str, int], side: int, half: int):
        self.counts, self.turned, self.half = counts, side == 1, half
        self.found: dict[str, list] = {}

    def pair(self, a: str, b: str) -> None:
        if self.turned:
            a, b = a[::-1], b[::-1]
            if a[: self.half] == b[: self.half]:
                return  # they meet on the other side
        for x, y in ((a, b), (b, a)):
            rank = (-self.counts[y], y)
            had = self.found.get(x)
            if had is None:
                self.found[x] = [1, rank]
            else:
                had[0] += 1
                had[1] = min(had[1], rank)


def merge_tries(words: list[str], depth: int, size: int, pair: Callable[[str, str], None]) -> None:
    """Every pair of near words of ``size`` or ``size`` and ``size + 1`` code points, all with the same first ``depth``."""
    words, there = sorted(words), set(words)
    nodes = [(0, len(words), depth)]
    while nodes:
        low, high, d = nodes.pop()
        while high - low > 1:  # down a heavy path
            prefix = words[low][:d]
            children, i = [], low + (len(words[low]) == d)
            ends = i > low  # a word ends at this node
            while i < high:
                letter, j = words[i][d], i + 1
                while j < high and words[j][d] == letter:
                    j += 1
                children.append((j - i, i, j, letter))
                i = j
            _, heavy_low, heavy_high, heavy = max(children)
            if ends and len(prefix) == size and prefix + heavy in there:
                pair(prefix, prefix + heavy)
            any_letter: dict[str, list[str]] = defaultdict(list)
            for count, i, j, letter in children:
                if i == heavy_low:
                    continue
                if count > 1:
                    nodes.append((i, j, d + 1))
                for word in words[i:j]:
                    rest = word[d + 1 :]
                    if len(word) == size:
                        for other in any_letter[rest]:
                            pair(word, other)
                        any_letter[rest].append(word)
                        if (other := prefix + heavy + rest) in there:
                            pair(word, other)
                        if (other := prefix + heavy + letter + rest) in there:
                            pair(word, other)
                    elif rest[:1] != letter and (other := prefix + rest) in there:
                        pair(word, other)
            low, high, d = heavy_low, heavy_high, d + 1


def meet_at(words: list[tuple[str, bool]], depth: int, size: int, pair: Callable[[str, str], None]) -> None:
    """As one node of ``merge_tries``: words (whole, or without the character at ``depth``) that leave the same rest."""
    whole = [w for w, skipped in words if not skipped]
    short = [w for w, skipped in words if skipped and len(w) == size]
    for i, word in enumerate(short):
        for other in short[:i]:
            pair(word, other)
    for word, skipped in words:
        if skipped and len(word) > size:
            for other in whole:
                if other[depth : depth + 1] != word[depth]:
                    pair(word, other)


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Sorted rows group by group: the key, and lists of the other columns."""
    now, held = None, None
    for batch in batches:
        if not len(batch):
            continue
        columns = {f: batch.column(f).to_pylist() for f in batch.schema.names}
        ids = list(zip(*(columns.pop(k) for k in keys), strict=True))
        cuts = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
        for low, high in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if ids[low] != now:
                if held:
                    yield now, held
                now, held = ids[low], {c: [] for c in columns}
            for c, values in columns.items():
                held[c] += values[low:high]
    if held:
        yield now, held


def _search(rows: DataFrame, level: bool) -> DataFrame:
    """Near words within each group: by a trie, or (``level``) at the node of the key alone."""
    keys = [*_KEYS, "rest"] if level else _KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "rank", "form"])
        for (side, size, key, *_), group in _by_group(batches, keys):
            if len(group["text"]) < 2:
                continue
            near = Near(dict(zip((t[::-1] if side else t for t in group["text"]), group["n"], strict=True)), side, size // 2)
            if level:
                meet_at(list(zip(group["text"], group["skipped"], strict=True)), len(key), size, near.pair)
            else:
                merge_tries(group["text"], len(key), size, near.pair)
            out += [(word, count, rank, form) for word, (count, (rank, form)) in near.found.items()]
            if len(out) > 50_000:
                yield flush()
                out.clear()
        if out:
            yield flush()

    rows = rows.select(*keys, "text", "n", *(["skipped"] if level else []))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _PART)


def _near_parts(words: DataFrame, min_length: int) -> list[DataFrame]:
    length = F.char_length("word")
    sizes = F.filter(F.array(length, length - 1), lambda m: m >= min_length)
    half = F.floor(F.col("size") / 2).cast("int")
    rows = words.select("word", "n", F.explode(sizes).alias("size")).select("n", "size", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("text"), half.alias("depth")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("text"), (F.col("size") - half).alias("depth")))).alias("x"))
    rows = rows.select("n", "size", "x.side", "x.text", F.expr("substring(x.text, 1, x.depth)").alias("key"))
    parts = []
    while True:
        large = materialize(rows.groupBy(*_KEYS).count().where(F.col("count") > GROUP_WORDS).drop("count"))
        if large.isEmpty():
            return [*parts, _search(rows, False)]
        parts.append(_search(rows.join(large, _KEYS, "left_anti"), False))
        rows = materialize(rows.join(large, _KEYS, "left_semi"))
        depth = F.char_length("key")
        short = F.char_length("text") == F.col("size")
        left = F.array(
            F.when(F.char_length("text") > depth, F.struct(F.lit(True).alias("skipped"), F.expr("substring(text, char_length(key) + 2)").alias("rest"))),
            F.when(short, F.struct(F.lit(False).alias("skipped"), F.expr("substring(text, char_length(key) + 1)").alias("rest"))),
        )
        parts.append(_search(rows.select("*", F.explode(left).alias("x")).where("x is not null").select("*", "x.*"), True))
        rows = rows.where(F.char_length("text") > depth).withColumn("key", F.expr("substring(text, 1, char_length(key) + 1)"))


def group_variants(counts: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words in ``counts`` (``word, n``; rows of one word are added up).

    Words of ``min_length`` code points and ``min_count`` occurrences take part; null doesn't.  ``n_near``:
    words exactly one edit away.  ``form``: the one of them of the largest n (ties: the
    smallest), if that is ``factor`` times the word's or more.  ``root``: where forms lead to, the word
    itself without one; every step multiplies n, so none leads back.
    """
    words = counts.where(F.char_length("word") >= max(1, min_length)).groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words.where(F.col("n") >= min_count))
    every = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("string").alias("form"))
    for part in _near_parts(words, max(1, min_length)):
        every = every.unionByName(part.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("rank", "form")))
    near = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.rank")
    is_form = form_n >= F.lit(factor) * F.col("n")
    near = materialize(near.select("word", "n", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, form_n).alias("form_n")))
    return near.join(_roots(near.where("form is not null").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` by doubling: each round follows as many links as all rounds before."""
    roots = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("at"), F.col("root").alias("then"))
        further = materialize(roots.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        roots = further.select("word", "root")
