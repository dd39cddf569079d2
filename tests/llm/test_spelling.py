"""Near words against all pairs, and words against a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest

from meridia.llm import queries as Q
from meridia.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=10):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if w != word and is_near(w, word)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= factor * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)
    rows = []
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.append((word, form, root, n, n_near, form_n))
    return sorted(rows)


def plain_counts(rows):
    out = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return out


def vocabulary(least, letters, n, seed):
    """Words of few letters, with runs, edits of edits, and counts over many sizes."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(least, least + 4))) for _ in range(n)}
    for word in list(words)[: n // 2]:
        i = rng.randrange(len(word) + 1)
        words |= {word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]}
    words |= {"a" * k for k in range(least, least + 9)} | {"ab" * 6, "ba" * 6, "a" * 40, "a" * 40 + "b"}
    return {w: rng.choice([1, 2, 2, 3, 20, 30, 200, 5000, 60000]) for w in sorted(words) if len(w) >= least}


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_tries_meet_each_pair_once(seed):
    """Words with the same first two code points."""
    words = ["xy" + w for w in vocabulary(5, "abé", 300, seed)]
    for size in range(7, 12):
        found = Counter()
        spelling.merge_tries([w for w in words if len(w) in (size, size + 1)], 2, size, lambda a, b: found.update([tuple(sorted((a, b)))]))
        assert found == Counter(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if is_near(a, b) and min(len(a), len(b)) == size)


@pytest.mark.parametrize(("limit", "letters", "least"), [(spelling.GROUP_WORDS, "abé", 7), (2, "ab", 7), (5, "aéb", 1)])
def test_against_all_pairs(spark, monkeypatch, limit, letters, least):
    """Also with groups so small that upper levels of the trie are done by shuffles."""
    monkeypatch.setattr(spelling, "GROUP_WORDS", limit)
    counts = vocabulary(least, letters, 150, limit)
    rows = [(w, n - 1, 0) for w, n in counts.items()] + [(w, 1, 0) for w in counts] + [(None, 50, 0), ("", 50, 0)]
    got = rows_of(spelling.group_variants(spark.createDataFrame(rows, "word string, n long, root int"), min_length=least))
    assert got == brute({w: n for w, n in counts.items() if n >= 2})
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of forms


def test_words_of_documents(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    texts = ["Straßenbahn STRASSENBAHN ÉCOLES écoles×÷ wordsĀwords naïveté", None, "", "x" * 5000 + " " + "longest " * 3000, "123 ab\tcdefghij klmnopq", "日本語 letters"] + ["Copies copies copied copying"] * 200
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n int, word string").repartition(3)
    got = Counter()
    for word, n in spelling.count_words(docs, drop_every=31).collect():
        got[word] += n
    assert got == plain_counts(enumerate(texts))
    plain = Counter()
    for word, n in spelling.count_words(docs).collect():
        plain[word] += n
    assert plain["copying"] == 200
    nobody = spark.createDataFrame([(None, "letters")], "doc_id long, text string")
    assert spelling.count_words(nobody).count() == 1


def test_empty(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    counts = {w: n for w, n in plain_counts(docs).items() if n >= 2}
    assert rows_of(Q.op13_spelling_variant_grouping(spark, d)) == brute(counts)
