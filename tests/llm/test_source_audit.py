"""The audit of sources against a plain count of all terms."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from meridia.llm import queries as Q
from meridia.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs=10, top=10):
    counts, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        counts.update((lang, source, t) for t in terms)
        docs.update({(lang, t) for t in terms})
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= min_docs:
            kept[lang].append(t)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, source in groups:
        terms, others = kept[lang], [s for g, s in groups if g == lang]
        share = lambda sources, t: 1 + 10**9 * (sum(counts[lang, s, t] for s in sources) + 2) // (sum(counts[lang, s, u] for s in sources for u in terms) + 2 * len(terms))  # noqa: B023, E731
        own = {t: share([source], t) for t in terms}
        parts = {"pair": [(s, sum(f(own[t], share([s], t)) for t in terms)) for s in others if s != source]}
        parts["term"] = [(t, f(own[t], q)) for t in terms if counts[lang, source, t] and own[t] > (q := share(others, t))]
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(items, 1) if part == "pair" or i <= top]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["the", "The", "of", "été", "École", "naïve", "日本", "x", "zz", "rare"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "B", "é", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for _ in range(150)]
    rows += [("en", "a", "the of 1the2of_the-été")] * 40  # a hot source, copies
    rows += [("en", "quiet", None), ("en", "silent", ""), ("de", "alone", "ein zwei"), ("de", "other", "drei"), ("one", "one", "x " * 50), ("en", "long", "the été " * 30_000)]
    return rows


@pytest.mark.parametrize("held", [source_audit.HELD, 3])
def test_against_plain_counts(spark, monkeypatch, held):
    monkeypatch.setattr(source_audit, "HELD", held)
    rows = corpus()
    docs = spark.createDataFrame([(t, s, lg, 7, "x") for lg, s, t in rows], "text string, source string, lang string, n int, item string").repartition(5)
    assert sorted(map(tuple, source_audit.audit_sources(docs).select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows)


def test_counts_beyond_64_bits_of_product(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(source_audit._share(F.lit(9 * 10**12), F.lit(10**13), F.lit(1000), 2).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**12 + 2) // (10**13 + 2000)


def test_empty(spark):
    assert source_audit.audit_sources(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    cur = con.execute(Q.oracle_sql()["op12_source_divergence_audit"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert want and sorted(map(tuple, Q.op12_source_divergence_audit(spark, d).select(*names).collect())) == want
