"""Training-data operators against brute force, round trips and hand-made edge cases."""

import codecs
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from meridia.llm import ann, bpe, chat, kernels, quality, stages, tokens, warc
from meridia.llm import queries as Q
from meridia.llm import substring_dedup as sub
from meridia.llm.decontaminate import contaminated_words
from meridia.llm.line_dedup import dedup_lines
from meridia.llm.near_dedup import near_duplicates

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, score double, ids string, n_words long, component_id string, span int"


def fold(x):
    return "".join(c.lower() if c < "\x80" else c for c in x or "")


def table(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, 0.5, "x", 9, "c", 1) for i, t in rows], SCHEMA)


def corpus():
    """Copies, near copies, shared passages, long and odd texts."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = prose(150), prose(70)
    out = [(i, " ".join(prose(rng.randint(1, 160)))) for i in range(1, 20)]
    for i in range(20, 45):  # near copies of one text, with one to eight words changed
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    out += [(i, " ".join([*prose(30), *passage, *prose(30)])) for i in range(45, 52)]
    out += [(52, None), (53, ""), (54, " \n\t "), (55, "One Two"), (56, "one two"), (57, " ".join(base)), (57, " ".join(base)), (58, "same " * 130), (59, "same " * 90), (60, "\n".join(" ".join(prose(9)) for _ in range(300))), (None, " ".join(base))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).repartition(3).cache()


def by_id(df, *cols):
    return {tuple(r) for r in df.select("doc_id", *cols).collect()}


def test_near_duplicates(spark, docs):
    sets = {}
    for i, t in corpus():
        w = re.findall(WORD, fold(t))
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    got = near_duplicates(docs, 85)
    assert by_id(got, "n_shingles", "component_id", "kept") == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()} | {(None, 146, None, True)}
    assert got.count() == docs.count()
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("runs", [3, 32_768])
def test_repeats(spark, docs, runs, monkeypatch):
    monkeypatch.setattr(sub, "GROUP_RUNS", runs)
    monkeypatch.setattr(sub, "CHUNK_RUNS", 40)
    seen, want = {}, {(None, 150, 0, hashlib.sha256(corpus()[-1][1].encode()).hexdigest())}
    for i, t in sorted((r for r in corpus() if r[0] is not None), key=lambda r: r[0]):
        w = re.findall(WORD, t or "")
        gone = set()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                gone |= set(range(k, k + 50))
        want.add((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = sub.remove_repeats(docs, 50)
    assert by_id(got.withColumn("sha", F.sha2("kept_text", 256)), "n_words", "n_removed", "sha") == want
    assert got.count() == docs.count()


@pytest.mark.parametrize("limit", [1, 500_000])
def test_contaminated_words(spark, docs, limit, monkeypatch):
    monkeypatch.setattr("meridia.llm.decontaminate.BROADCAST_FINGERPRINTS", limit)
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    texts = dict(corpus())
    items = [(1, texts[45][200:420].upper()), (2, "ONE two"), (2, "ONE two"), (3, None), (4, " .. "), (None, texts[20]), (5, " ".join(texts[58].split()[:12])), (6, texts[60][:300])]
    win = {}
    for i, t in items:
        w = re.findall(words, fold(t))
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            win.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = set()
    for i, t in corpus():
        w, hit, found = re.findall(words, fold(t)), set(), set()
        for n in {len(g) for g in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit |= set(range(k, k + n))
                    found |= win[tuple(w[k : k + n])]
        want.add((i, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    got = contaminated_words(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.n_words, tuple(r.hits), tuple(r.item_ids)) for r in got.collect()} == want
    assert sum(len(x[2]) > 0 for x in want) >= 5


def test_no_benchmark(spark, docs):
    got = contaminated_words(docs, spark.createDataFrame([], "item_id long, text string"))
    assert got.where("size(hits) > 0").count() == 0 and got.count() == len({i for i, _ in corpus()})


def test_lines(spark):
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta\n\nshort\n  Alpha BETA gamma delta epsilon zeta eta theta "), (2, "alpha beta gamma delta epsilon zeta eta thetas\nown line of two"),
        (3, "alpha beta gamma delta epsilon zeta eta theta"), (4, None), (5, ""), (6, "\n\n"), (7, "Short\nété été été été été été"), (8, "été été été été été étés\nlast"), (None, "short"), (9, "short\r"),
    ]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(table(spark, rows)).collect()}
    assert got[1] == ("Alpha beta gamma delta epsilon zeta eta theta\n\nshort", 1)
    assert got[2] == ("own line of two", 1) and got[3] == ("", 1)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("\n\n", 0) and got[None] == ("short", 0)
    assert got[7] == ("été été été été été été", 1) and got[8] == ("last", 1) and got[9] == ("", 1)
    assert dedup_lines(table(spark, rows).limit(0)).count() == 0


def brute_lines(rows, percent=80):
    """Which lines go, by comparing all pairs of lines."""
    place, keep = {}, {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n") if i is not None else []):
            line = fold(line.strip(" \t\r\v\f"))
            if line:
                place.setdefault(line, []).append((i, n))
    sets = {x: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in place}
    part = {x: x for x in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for x in sets:
        for y in sets:
            n = len(sets[x] & sets[y])
            if x < y and n and 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                part[find(x)] = find(y)
    for x in sets:
        keep[find(x)] = min(keep.get(find(x), (1 << 62, 0)), min(place[x]))
    return {p for x in sets for p in place[x] if p != keep[find(x)]}


@pytest.mark.parametrize("records", [1 << 20, 500])
def test_lines_against_all_pairs(spark, records, monkeypatch):
    monkeypatch.setattr("meridia.llm.line_dedup.FLUSH_RECORDS", records)
    monkeypatch.setattr("meridia.llm.line_dedup.PART_RECORDS", 4 * records)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(rng.randint(3, 60)) for _ in range(40)]

    def near():
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):  # edits anywhere in the line
            x[rng.randrange(len(x))] = rng.choice("abcX é")
        return rng.choice(["", " ", "\t"]) + "".join(x) + rng.choice(["", " ", "\r"])

    rows = [(i, "\n".join(rng.choice([near(), near(), prose(rng.randint(0, 9)), "", "ab", "Same LINE everywhere in the corpus"]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, base[0]), (503, base[1] + "\n" + base[1].upper()), (-4, base[2]), (504, "long " * 60_000), (505, "long " * 60_001 + "\nend"), (506, rows[0][1])]
    gone = brute_lines(rows)
    want = {}
    for i, t in rows:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        want[i] = (kept, sum(d == i for d, _ in gone))
    assert len(gone) > 300
    got = dedup_lines(spark.createDataFrame([(i, t, "g", 1) for i, t in rows], "doc_id long, text string, gone string, node int").repartition(5))
    assert {r.doc_id: (r.text, r.n_removed) for r in got.collect()} == want
    assert got.columns == ["doc_id", "gone", "node", "text", "n_lines", "n_removed"]


def test_stray_nodes_of_a_hub_are_linear(spark):
    """One bucket: many nodes that all link with the hub, and a few that link with nothing."""
    from meridia.llm.graph import linked_components
    from meridia.llm.near_dedup import _measure

    core = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i.cast("long"))
    spent = []
    for n in (4_000, 4_000, 32_000):
        nodes = spark.range(n).withColumn("body", F.when(F.col("id") % 1000 == 1, F.transform(core, lambda i: F.when(i > 20, i + F.col("id") * 1000).otherwise(i))).otherwise(F.array_append(core, F.col("id") + 10**9)))
        nodes = nodes.withColumnRenamed("id", "node").cache()
        began = time.time()
        parts = linked_components(nodes.select(F.lit(5).cast("long").alias("bucket"), "node"), nodes, 80, _measure, lambda rows: rows.withColumnRenamed("body", "x"))
        sizes = [r[0] for r in parts.groupBy("component").count().select("count").collect()]
        spent.append(time.time() - began)
        assert sizes == [n - n // 1000]
    assert spent[2] < 8 * spent[1]  # eight times the nodes


def test_a_share_of_strays_of_a_hub_is_linear(spark):
    """One bucket: a quarter of the nodes don't link with the hub, but with each other."""
    from meridia.llm.graph import linked_components
    from meridia.llm.near_dedup import _measure

    core = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i.cast("long"))
    spent = []
    for n in (2_000, 2_000, 16_000):
        stray = F.transform(core, lambda i: F.when(i > 20, i + 10**6).otherwise(i))
        body = F.when(F.col("id") % 4 == 1, F.array_append(stray, F.col("id") % 3 + 10**9)).otherwise(F.array_append(core, F.col("id") + 10**10))
        nodes = spark.range(n).withColumn("body", body).withColumnRenamed("id", "node").cache()
        began = time.time()
        parts = linked_components(nodes.select(F.lit(5).cast("long").alias("bucket"), "node"), nodes, 80, _measure, lambda rows: rows.withColumnRenamed("body", "x"))
        sizes = sorted(r[0] for r in parts.groupBy("component").count().select("count").collect())
        spent.append(time.time() - began)
        assert sizes == [n // 4, n - n // 4]
    assert spent[2] < 4 * spent[1]  # eight times the nodes


def test_line_spans_of_blocks():
    texts = ["a\nb\n", "", "\n", "c", "d\n\ne"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    from meridia.llm.line_dedup import _lines

    starts, ends, row = _lines(data, offsets)
    got = [[] for _ in texts]
    for a, b, r in zip(starts, ends, row, strict=True):
        got[r].append(data[a:b].tobytes().decode())
    assert got == [t.split("\n") for t in texts]


def test_word_kernels():
    texts = ["A b\tA", "", "é" * 10 + " x", " lead trail "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    h, n = kernels.words_of(data, np.cumsum([0, *(len(t.encode()) for t in texts)]), lower=True)
    assert n.tolist() == [3, 0, 2, 2] and h[0] == h[2] and len(set(h.tolist())) == 6
    long = ("word " * 600_000).encode()
    h, n = kernels.words_of(np.frombuffer(long, np.uint8), np.array([0, len(long)]), lower=False)
    assert n.tolist() == [600_000] and len(set(h.tolist())) == 1


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    probes = kernels.probe_table(128)
    for shared, own in ((400, 50), (9, 1), (60, 60)):
        agree = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64) * np.uint64(2)
            sigs = [kernels.one_permutation(np.sort(s), np.zeros(len(s), int), 1, 128, probes)[0] for s in (x[: shared + own], np.concatenate([x[:shared], x[shared + own :]]))]
            agree.append((sigs[0] == sigs[1]).mean())
        assert np.mean(agree) == pytest.approx(shared / (shared + 2 * own), abs=0.06)


def test_bpe_equals_tiktoken(spark, monkeypatch):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    encoder, rng = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(3)
    for _ in range(600):
        text = "".join(rng.choice("aaab ee\n\t  éß漢字😀%%**!!'s're 12345The theing‍") for _ in range(rng.randint(0, 150)))
        assert encoder.encode(text).tolist() == reference.encode_ordinary(text)
    text = "a" * 30_000 + " " * 500 + "<|endoftext|>"
    assert encoder.encode(text).tolist() == reference.encode_ordinary(text)
    ids = list(RANKS.values())
    for _ in range(5000):  # which tokens may follow each other, against merging itself
        a, b = rng.choice(ids), rng.choice(ids)
        x, y = encoder.transducer.token[a], encoder.transducer.token[b]
        assert encoder.transducer._follows(a, b) == (bpe.merge_by_rank(RANKS, x + y) == [x, y])
    rows = [(1, "Thé 漢字 😀"), (2, None), (3, ""), (4, " x ")]
    # white space in all orders: words are looked up up to spaces, or split by the pattern
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    bits = ["a", "b ", " ", "\n", "\t", "'s", "9", ",", "é", "\xa0", "\u3000", "\x1c", "x y", "<|", "word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    assert [ids.tolist() for ids in encoder.encode_all(texts)] == known.encode_ordinary_batch(texts)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 5)  # tokens leave as soon as they are settled
    monkeypatch.setattr(bpe, "MAX_MOVES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    for text in texts[:300]:
        piece = (text * 3).encode()
        assert [encoder.transducer.token[t] for t in encoder.transducer.encode(piece)] == ([piece] if piece in RANKS else bpe.merge_by_rank(RANKS, piece))
    assert [ids.tolist() for ids in encoder.encode_all(texts)] == known.encode_ordinary_batch(texts)
    monkeypatch.undo()
    coded = bpe.encode(table(spark, rows), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: reference.encode_ordinary(t or "") for i, t in rows}
    assert {r.doc_id: r.decoded for r in bpe.decode(coded.select("doc_id", "ids"), RANKS).collect()} == {i: t or "" for i, t in rows}


def test_streamed_utf8(spark):
    """Against the incremental decoder of the standard library, however the bytes are cut into tokens."""
    single = [bytes([b]) for b in range(256)]
    pairs = [bytes([a, b]) for a in (0x61, 0xC3, 0xE2, 0xF0, 0x9F, 0x98) for b in (0x62, 0x80, 0xA9, 0xC3, 0xFF)]
    rng = random.Random(6)
    streams = [b"", b"\xf0\x9f", b"\xe0\x80\xff a", b"\xc3", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xf0\x9f\x98a\xf0\x9f\x98\x80", "aé漢😀b".encode()]
    streams += [bytes(rng.choice([0x61, 0x80, 0x9F, 0xA9, 0xC3, 0xE2, 0xE0, 0xED, 0xF0, 0xF4, 0xFF]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    decoder = bpe.StreamDecoder([*single, *pairs, None])
    for data in streams:
        incremental = codecs.getincrementaldecoder("utf-8")(errors="replace")
        decoder.reset()
        i, got, want = 0, b"", ""
        while i < len(data):
            two = data[i : i + 2]
            token = 256 + pairs.index(two) if two in pairs and rng.random() < 0.7 else data[i]
            step = 2 if token > 255 else 1
            got += decoder.feed(np.array([token]))
            want += incremental.decode(data[i : i + step])
            assert len(decoder.held) < 4
            i += step
        assert (got + decoder.finish()).decode() == want + incremental.decode(b"", final=True)
        decoder.reset()
        assert (decoder.feed(np.frombuffer(data, np.uint8).astype(np.int64)) + decoder.finish()).decode() == data.decode("utf-8", "replace")
    with pytest.raises(ValueError):
        decoder.feed(np.array([256 + len(pairs)]))
    ranks = {t: i for i, t in enumerate(single)}
    rows = spark.createDataFrame([(k, list(data) or None) for k, data in enumerate(streams)], "doc_id long, ids array<int>").repartition(2)
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, ranks).collect()} == {k: data.decode("utf-8", "replace") for k, data in enumerate(streams)}
    assert bpe.decode(rows.limit(0), ranks).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    n = 12_000  # the walk meets a sixth of them
    e = np.round(rng.normal(size=(n, 16)) + rng.integers(0, 4, (n, 1)) * 2, 3).astype(np.float32)
    e[7], e[9], e[300:500] = e[100], 0, e[200]  # copies, no direction, a hot cell
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(e)]
    odd = [(n + 1, None), (n + 2, [float("nan")] * 16), (n + 3, []), (n + 4, [1.0] * 15 + [None]), (None, [1.0] * 16), (100, [9.0] * 16)]  # the second vector of 100 is larger
    short = [(20_000, [1.0, 2.0]), (20_001, [1.0, 2.5]), (20_002, [4.0, 6.0]), (20_100, [3.0])]
    t = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows + odd + short], "vec_id long, embedding array<float>, query_id string, score double")
    got = {}
    for r in ann.nearest(t, t.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = total = 0
    for q in range(0, n, 100):
        d = np.sqrt(((e.astype(float) - e[q].astype(float)) ** 2).sum(1))
        if q == 100 and e[100].tolist() > [9.0] * 16:
            continue
        order = [i for i in np.lexsort((np.arange(n), d)) if i not in (q, 9)][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(m[2] - d[m[1]]) < 1e-9 for m in mine)
        good += len({m[1] for m in mine} & set(order))
        total += 10
    assert good / total >= 0.9 and ann.enough_entries(n, 10) < n / 4
    assert [(r, i) for r, i, _ in sorted(got[20_000])] == [(1, 20_001), (2, 20_002)] and sorted(got[20_000])[0][2] == 0.5
    assert 20_100 not in got and not {n + 1, n + 2, n + 3, n + 4, 9} & {m[1] for v in got.values() for m in v}
    assert ann.nearest(t.limit(0), t).count() == 0 and ann.nearest(t, t.limit(0)).count() == 0


def test_nearest_fits_in_tasks(spark, monkeypatch):
    """Centroids are fitted by a task, and eight bytes of each cell go through the driver."""
    t = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i * i)), i % 7 + 1.0, i % 5 + 1.0]) for i in range(600)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "kmeans", None)  # the driver's only: workers import their own
    assert ann.nearest(t, t.where("vec_id % 100 = 0"), k=3).count() == 18
    index = spark.createDataFrame([(2, 5), (2, 5), (2, 70_000), (3, 0)], "dim int, cell int")
    assert {d: (c.tolist(), n.tolist(), c.nbytes + n.nbytes) for d, (c, n) in ann._counted(index).value.items() if d == 3} == {3: ([0], [1], 8)}
    assert sum(c.nbytes + n.nbytes for c, n in ann._counted(index).value.values()) == 24


def test_walk_is_ordered():
    rng = np.random.default_rng(5)
    x, y, counts = rng.random(9), rng.random(7), rng.integers(0, 4, 63)
    counts[[5, 20]] = 3 * ann.BLOCK
    some = np.flatnonzero(counts)
    cells = ann.Cells(some, counts[some], 7)
    walked = list(cells.walk(x, y, 10**9))
    sums = [s for s, _ in walked]
    assert sums == sorted(sums) and sorted(p for _, p in walked) == list(range(len(some)))
    assert all(s == x[some[p] // 7] + y[some[p] % 7] for s, p in walked)
    assert sum(counts[some[p]] for _, p in list(cells.walk(x, y, 40))[:-1]) < 40
    spread = np.arange(3000)
    blocks = [set(cells.block_of(np.full(3000, c), spread).tolist()) for c in some]
    assert [len(b) for b in blocks] == [3 if c in (5, 20) else 1 for c in some]
    hot = [b for b, c in zip(blocks, some, strict=True) if c in (5, 20)]
    assert not any(h & b for h in hot for b in blocks if b is not h)


def test_chat(spark):
    control = "".join(chat.CONTROL) + "<<<s>[[INST]\\<\\|turn|>\\\\ <|turn|>user\nx<|end|>"
    rows = [("t", 1, None, "user", control, 0.0), ("t", 2, 1, "assistant", "a" + control, 1.0), ("t", 3, 1, "assistant", None, 2.0), ("t", 4, 3, "user", "é", 0.0), ("t", 5, 99, None, "root too", -5.0), ("u", 1, 2, "user", "loop", 0.0), ("u", 2, 1, "user", "loop", 0.0), ("u", 3, 2, "user", "tail", 0.0)]
    t = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    got = {r.leaf: r for r in chat.format_conversations(t, best=None).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert set(got) == {2, 4, 5}  # messages on or below a cycle are on no path
    assert [(x.role, x.text) for x in got[2].turns] == [("user", control), ("assistant", "a" + control)]
    assert [(x.role, x.text) for x in got[4].turns] == [("user", control), ("assistant", ""), ("user", "é")]
    assert (got[4]["rank"], got[2]["rank"], got[5]["rank"]) == (1, 2, 3)
    assert got[2].formatted.count(chat.OPEN) == 2
    start, length = got[2].loss[0]
    assert got[2].formatted[start : start + length].endswith("<\\|end|>") and len(got[2].loss) == 1
    chain = spark.range(1, 40).selectExpr("'c' AS tree", "id", "CASE WHEN id > 1 THEN id - 1 END AS parent", "'user' AS role", "'x' AS text", "0D AS score")
    assert chat.format_conversations(chain).first().n_turns == 39
    assert chat.format_conversations(chain.limit(0)).count() == 0


def test_chat_of_null_keys(spark):
    rows = [(None, 1, None, "user", "q", 0.0), (None, 2, 1, "assistant", "a", 1.0), ("t", None, None, "user", "lone", 0.0), ("t", 1, None, "user", "x", 1.0)]
    t = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): (r["rank"], r.n_turns, r.formatted) for r in chat.format_conversations(t, best=None).collect()}
    assert got == {
        (None, 2): (1, 2, "<|turn|>user\nq<|end|><|turn|>assistant\na<|end|>"), ("t", 1): (1, 1, "<|turn|>user\nx<|end|>"), ("t", None): (2, 1, "<|turn|>user\nlone<|end|>"),
    }


def test_chat_of_odd_roles_and_repeated_rows(spark):
    roles = ["us<|end|>\ner", "a\\nb", "\\\n\\", "<|turn|>\n\n", "assistant", ""]
    rows = [("t", i, i - 1 if i else None, r, f"x\n{r}", 0.0) for i, r in enumerate(roles)]
    t = spark.createDataFrame(rows + rows[:2] + [("t", 1, 0, "a\\nb", "y", 0.0)], "tree string, id long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    got = chat.format_conversations(t).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    assert [[(x.role, x.text) for x in r.turns] for r in got] == [[(r, f"x\n{r}") for r in roles]]
    start, length = got[0].loss[0]
    assert got[0].formatted[start : start + length] == "x\nassistant" and len(got[0].loss) == 1


def test_repeated_record_ids(spark):
    rows = [(1, "u", 1, "response", 200, "e", None, {"A": "1"}), (1, "u", 2, "response", 200, "f", None, {"A": "2"}), (2, "u", 5, "revisit", 304, "f", None, {}), (2, "u", 5, "revisit", 304, "f", None, {})]
    t = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>")
    assert [(r.source_id, r.outcome, r.headers) for r in warc.resolve_revisits(t.withColumn("span", F.lit(0))).collect()] == [(1, "resolved", {"a": "2"})] * 2


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    good = lambda n: " ".join(rng.choice(["calm", "river", "stone", "green", "walk", "hill", "cloud", "bird"]) + str(rng.randint(0, 40)) for _ in range(n)) + "."
    bad = lambda: " ".join(rng.choice(["CLICK!!", "BUY!!", "x | y", "win%%%"]) for _ in range(60))
    rows = [(i, good(60) if i % 2 else bad()) for i in range(300)]
    base, leak = good(80), good(14)
    rows += [(400, base), (401, base.replace(".", " end.")), (402, good(20) + " " + leak + " " + good(20)), (403, "A line that is in many documents of it\n" + good(30)), (404, "A line that is in many documents of it\n" + good(30)), (405, "A line that is in many documents of it\n \t\n"), (None, good(30)), (None, leak + " " + good(9)), (406, None), (407, ""), (408, good(12_000))]
    schema = "doc_id long, text string, score double, n_lines string, gone string, hits int, n_chars int, ids string"
    docs = spark.createDataFrame([(i, t, 0.5, "n", "g", 1, len(t or ""), "x") for i, t in rows], schema)
    spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    scored = {(r.doc_id, r.text): r.s for r in quality.score_documents(docs.drop("score"), quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).withColumnRenamed("score", "s").collect()}
    one = stages.classify(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and texts(one) == sorted((r for r in rows if scored[r] >= 0.7), key=str)
    assert {i for i, _ in texts(one)} >= set(range(1, 300, 2)) | {400, 401, 402} and not {i for i, _ in texts(one)} & set(range(0, 300, 2))

    kept = [r for r in rows if r[0] is None or r[0] > 300 or r[0] % 2]  # later stages get rows of every kind
    given = lambda rows: spark.createDataFrame([(i, t, 0.5, "n", "g", 1, len(t or ""), "x") for i, t in rows], schema)
    gone = brute_lines(kept)
    want = []
    for i, t in kept:
        lines = [x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone]
        if t is None or len(lines) == len(t.split("\n")) or "".join(lines).strip():
            want.append((i, t if t is None else "\n".join(lines)))
    two = stages.dedup(spark, given(kept), str(tmp_path))
    assert texts(two) == sorted(want, key=str) and two.columns == docs.columns and 405 not in {i for i, _ in want}
    assert all(r.n_chars == len(r.text or "") and r.n_lines == "n" and r.gone == "g" for r in two.collect())

    three = stages.near_dedup(spark, given(kept), str(tmp_path))
    assert texts(three) == sorted((r for r in kept if r[0] != 401), key=str) and three.columns == docs.columns
    four = stages.decontaminate(spark, given(kept), str(tmp_path))
    assert 402 not in {r.doc_id for r in four.collect()} and leak not in " ".join(t or "" for _, t in texts(four))
    shared = spark.createDataFrame([(None, "clean words only here"), (None, leak), (7, leak), (7, "other clean words"), (7, None)], "doc_id long, text string")
    assert texts(stages.decontaminate(spark, shared, str(tmp_path))) == sorted([(None, "clean words only here"), (7, "other clean words"), (7, None)], key=str)
    five = stages.tokenise(spark, given(kept), str(tmp_path)).collect()
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert sorted(((r.doc_id, r.token_ids) for r in five), key=str) == sorted(((i, reference.encode_ordinary(t or "")) for i, t in kept), key=str) and all(r.round_trip for r in five)
    for _, stage in stages.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_and_very_long_texts_of_operators(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, long), (2, "a " + long), (3, None), (4, "")]
    docs = table(spark, rows)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in sub.remove_repeats(docs).collect()} == {1: (200_000, 0), 2: (200_001, 200_000), 3: (0, 0), 4: (0, 0)}
    assert sub.remove_repeats(docs.limit(0)).count() == 0
    hits = contaminated_words(docs, spark.createDataFrame([(1, " ".join(long.split()[-12:]))], "item_id long, text string"))
    assert {r.doc_id: (r.n_words, len(r.hits) > 12) for r in hits.collect()} == {1: (200_000, True), 2: (200_001, True), 3: (0, False), 4: (0, False)}
    scores = tokens.zipf_scores(RANKS)
    counted = {r.doc_id: r.n_pretokens for r in tokens.count_tokens(docs, scores, public_tokenizers.PATTERN).collect()}
    assert counted[2] == counted[1] + 1 and counted[3] == counted[4] == 0
    assert tokens.count_tokens(docs.limit(0), scores, public_tokenizers.PATTERN).count() == 0
    model = quality.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score_documents(docs, model).count() == 4 and quality.score_documents(docs.limit(0), model).count() == 0


def test_revisits(spark):
    rows = [
        (1, "http://WWW.a.org/x/?b=2&utm_source=q&a=1#f", 10, "response", 200, "e1", "d1", {"ETag": "e1", "Content-Length": "5"}), (2, "https://a.org/x?a=1&b=2", 20, "revisit", 304, 'W/e1', None, {"Date": "new", "Content-Length": "0"}),
        (3, "https://a.org/x?a=1&b=2", 5, "revisit", 304, "e1", None, None), (4, "a.org/x?a=1&b=2", 30, "response", 404, "e2", None, {}), (5, "https://a.org/x?a=1&b=2", 40, "revisit", 304, "e2", "d1", None),
        (6, "https://a.org/x?a=1&b=2", 3_000_000, "revisit", 304, None, "d1", {}), (7, None, 50, "revisit", 304, "e1", None, {}), (8, "https://a.org/x?a=1&b=2", 60, "revisit", 304, None, None, {}),
    ]
    t = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>")
    got = {r.record_id: (r.source_id, r.outcome, r.headers) for r in warc.resolve_revisits(t).collect()}
    assert got == {
        2: (1, "resolved", {"etag": "e1", "content-length": "5", "date": "new"}), 3: (None, "orphan", None), 5: (None, "changed", None), 6: (1, "resolved", {"etag": "e1", "content-length": "5"}),
        7: (None, "orphan", None), 8: (None, "unverified", None),
    }
    assert warc.resolve_revisits(t.limit(0)).count() == 0


def test_token_counts(spark):
    scores = tokens.zipf_scores(RANKS)
    scorer, rng = tokens.TrieScorer(scores), random.Random(8)

    def plain(data):
        best = [(0.0, 0)]
        for n in range(1, len(data) + 1):
            best.append(max(((best[i][0] + scores[data[i:n]], best[i][1] - 1) for i in range(n) if data[i:n] in scores), key=lambda t: t))
        return -best[-1][1]

    for _ in range(300):
        word = "".join(rng.choice("abcthe ingé") for _ in range(rng.randint(1, 14)))
        assert scorer.pieces(word) == plain(word.encode())
    assert scorer.pieces("the" * 400) == plain(b"the" * 400)
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokens.count_tokens(table(spark, [(1, "the thing"), (2, None), (3, "")]), scores, public_tokenizers.PATTERN).collect()}
    assert got[2] == got[3] == (0, 0) and got[1] == (2, plain(b"the") + plain(b" thing"))


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["calm", "river", "stone", "green", "walk"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["CLICK!!", "BUY!!", "x | y", "win%%%"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)]
    docs = table(spark, [*rows, (1000, None), (1001, "")])
    labels = spark.createDataFrame([*((i, i % 2) for i, _ in rows), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = {r.doc_id: (r.score, r.held) for r in quality.score_documents(docs, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()}
    held = [i for i, _ in rows if out[i][1]]
    assert len(held) > 50 and sum((out[i][0] >= 0.7) == (i % 2 == 1) for i in held) >= 0.95 * len(held)
    assert 0 <= out[1000][0] == out[1001][0] <= 1
    assert quality.train(docs, labels.limit(0)).score(*quality.features(np.zeros(0, np.uint8), np.zeros(2, int)))[0] == pytest.approx(0.5)


def test_pairwise_terms_equal_the_double_sum():
    rng = np.random.default_rng(0)
    data = np.frombuffer(b"some words and some more", np.uint8)
    dense, row, bucket, value = quality.features(data, np.array([0, len(data)]))
    fm = quality.FactorisationMachine(0.1, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 3)) * 0.1, np.zeros(len(quality.DENSE)), np.ones(len(quality.DENSE)))
    x = np.zeros(quality.FEATURES)
    x[bucket], x[quality.WORD_BUCKETS :] = value, dense[0]
    on = np.flatnonzero(x)
    total = fm.bias + fm.linear @ x + sum(fm.factors[i] @ fm.factors[j] * x[i] * x[j] for a, i in enumerate(on) for j in on[a + 1 :])
    assert fm.score(dense, row, bucket, value)[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_gradients_of_the_classifier():
    """Against finite differences of the loss, for the bias, words, structure and all factors."""
    rng = np.random.default_rng(3)
    texts = [b"some words and some more", b"OTHER words, words | here", b"", b"some\nlines of text"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    dense, row, bucket, value = quality.features(data, offsets)
    label = np.array([1.0, 0.0, 1.0, 0.0])
    make = lambda: quality.FactorisationMachine(0.3, linear.copy(), factors.copy(), dense.mean(axis=0), np.maximum(dense.std(axis=0), 0.1))
    linear, factors = rng.normal(size=quality.FEATURES) * 0.3, rng.normal(size=(quality.FEATURES, 2)) * 0.2

    def loss(fm):
        p = fm.score(dense, row, bucket, value)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)) + 0.01 / 2 * (np.sum(fm.linear**2) + np.sum(fm.factors**2))

    bias, by_linear, by_factors = quality._gradients(make(), dense, row, bucket, value, label, 0.01)

    def moved(change):
        up, down = make(), make()
        change(up, 1e-5)
        change(down, -1e-5)
        return (loss(up) - loss(down)) / 2e-5

    assert moved(lambda fm, d: setattr(fm, "bias", fm.bias + d)) == pytest.approx(bias[0], abs=1e-8)
    at = [*np.unique(bucket)[:6], *range(quality.WORD_BUCKETS, quality.FEATURES), 7]
    for i in at:
        assert moved(lambda fm, d, i=i: fm.linear.__setitem__(i, fm.linear[i] + d)) == pytest.approx(by_linear[i], abs=1e-7)
        for f in range(2):
            assert moved(lambda fm, d, i=i, f=f: fm.factors.__setitem__((i, f), fm.factors[i, f] + d)) == pytest.approx(by_factors[i, f], abs=1e-7)


def test_query_names():
    assert set(Q.oracle_sql()) <= set(Q.queries())
    assert Counter(re.match(r"op\d+", n)[0] for n in Q.queries() if n != "pipeline") == {f"op{i}": 1 for i in range(1, 14)}
