"""Binary token files and their perfect hash index, against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridia.llm import queries as Q
from meridia.llm import token_files as T

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
    DEFINITION = file.read()
ODD = ["", " ", "\n", "a  b", "it's 'twas don't", "x́ y", "a ́b", "Straße ΑΣ Σ", "tab\tand\x1cfs\x85nel em", "<|endoftext|> <|startoftext|>x", "1234 ५६", "日本 語", "a\n\n̈b", "é" * 5000, "word " * 20000, "İI", "가 ᆨ", "e\r\nf", "…—!?", "end. End, .x ., a., é. é, 5. it's. don't, ≠ .̸ x.̸ A. B,C", "🙂 👩‍👩"]


def rows_of(df):
    return {(r.key, r.repeat): (r.start, r.n, np.frombuffer(r.ids, "<u4").tolist()) for r in df.collect()}


def expected(rows, end=1):
    """(key, repeat) -> ids; equal keys in any order of their texts."""
    whole = Tokenizer.from_str(DEFINITION)
    return [(k, whole.encode(t or "", add_special_tokens=False).ids + [end]) for k, t in rows]


def test_cut_texts_have_the_ids_of_whole_ones():
    whole = Tokenizer.from_str(DEFINITION)
    texts = ODD + [a + b for a in ODD[:12] for b in ODD[:12]]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for apart, width in ((True, 2), (False, 4)):
        encoder = T.Encoder(DEFINITION, apart, width)
        for part in (slice(0, 30), slice(20, None), slice(7, 7)):  # words known from before
            ids, n = encoder.encode(pa.array(texts[part], pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(want[part])] == want[part] and ids.itemsize == width


@pytest.mark.parametrize("small", [False, True])
def test_round_trip_and_keys(spark, tmp_path, monkeypatch, small):
    """Null, repeated and missing keys, null and long texts, clashing columns; tiny shards, blocks and buckets too."""
    if small:
        for name, value in (("SHARD_BYTES", 2000), ("READ_BYTES", 64), ("TEXT_BYTES", 500), ("BUCKET_KEYS", 3), ("SEEN", 3), ("KNOWN", 2)):
            monkeypatch.setattr(T, name, value)
    rows = list(enumerate(ODD)) + [(None, "no key"), (None, "none"), (3, "again"), (3, "again"), (99, None)] + [(7, f"row {i}") for i in range(300)]
    docs = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in rows], "doc_id long, text string, repeat int, key string, shard int").repartition(4)
    folder = f"{tmp_path}/t"
    T.write_ids(docs, folder, DEFINITION, end_id=1, apart=True)
    if small:
        assert T._shards(spark, folder).count() > 3
    got = rows_of(T.read_all(spark, folder))
    want = expected(rows)
    assert sorted((str(k), ids) for (k, _), (_, _, ids) in got.items()) == sorted((str(k), ids) for k, ids in want)
    order = sorted(got.items(), key=lambda x: x[1][0])
    assert [k for (k, _), _ in order] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    assert [x[1][0] for x in order] == np.cumsum([0] + [x[1][1] for x in order])[:-1].tolist()
    for key in (None, 3, 7):
        assert sorted(r for k, r in got if k == key) == list(range(sum(k == key for k, _ in rows)))
    asked = spark.createDataFrame([(5, 1), (5, 1), (-4, 1), (None, 1), (123456, 2)], "doc_id int, key int")
    some = rows_of(T.read_ids(spark, folder, T.lookup(spark, folder, asked)))
    assert some == {k: got[k] for k in [(5, 0), (None, 0)]}
    many = spark.range(-5000, 5000).select(F.col("id").alias("doc_id"))  # more than there are
    assert rows_of(T.read_ids(spark, folder, T.lookup(spark, folder, many))) == {k: v for k, v in got.items() if k[0] is not None and k[1] == 0}


def test_string_keys_and_wide_ids(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), ("é", None)], "url string, body string")
    T.write_ids(docs, f"{tmp_path}/t", DEFINITION, end_id=70_000, key="url", text="body")
    assert T.manifest(spark, f"{tmp_path}/t")["width"] == 4
    got = rows_of(T.read_all(spark, f"{tmp_path}/t"))
    assert [k for k, _ in sorted(got, key=lambda k: got[k][0])] == ["a", "b", "é"] and got["é", 0] == (5, 1, [70_000])


def test_empty_table_and_damage(spark, tmp_path):
    T.write_ids(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", DEFINITION)
    assert T.read_all(spark, f"{tmp_path}/none").count() == 0
    T.write_ids(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), f"{tmp_path}/t", DEFINITION)
    (part,) = (tmp_path / "t" / "ids").glob("part-*")
    part.write_bytes(part.read_bytes()[:-3] + b"xx\n")
    with pytest.raises(Exception, match="footer is damaged"):
        T.entries(spark, f"{tmp_path}/t", "bigint").collect()


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 5000):
        a, b = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
        perfect = T.PerfectHash.of(a, b)
        assert sorted(perfect.slots(a, b)) == list(range(n)) and len(perfect.bits) * 64 <= 5 * n + 2000
    same = np.full(2, 7, np.uint64)
    with pytest.raises(ValueError):
        T.PerfectHash.of(same, same)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    start, want = 0, []
    for k, ids in expected(docs):
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, Q.op11_perfect_hash_token_files(spark, d).collect())) == want
