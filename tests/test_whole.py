"""Registered queries over whole inputs, where their registered SQL reads a part."""

import hashlib
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the generated tables")


def pairs(df, sql):
    """Rows of a query and of SQL over the table files, written ``{name}``, as sorted text."""
    cur = duckdb.connect().execute(sql)
    names = [c[0] for c in cur.description]
    want = sorted(repr(r) for r in cur.fetchall())
    return sorted(repr(tuple(r)) for r in df.select(*names).collect()), want


def test_class_of_a_late_needle(spark, tmp_path):
    spark.createDataFrame([(15, "x" * 100 + " KHYĀL"), (31, "x" * 100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, entry.queries()["STR-6"](spark, str(tmp_path)).collect())) == [(15, "composed"), (31, None)]


@pytest.mark.parametrize("name", ["STR-5", "STR-6", "STR-7", "QRK-20", "STR-8", "RET-7", "SRC-1", "SRC-12", "LIM-2", "CAL-2", "QRK-2"])
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for file in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr(r) for r in cur.fetchall())
    assert want and sorted(repr(tuple(r)) for r in entry.queries()[name](spark, D).select(*[f"`{n}`" for n in names]).collect()) == want


@pytest.mark.parametrize("name", ["FLAGSHIP", "RET-3", "RET-4"])
def test_a_clip_for_each_recording(spark, name):
    """80 recordings."""
    big = "/root/testdata/sf0.1"
    sql = entry.oracle_sql()[name].replace("FROM embeddings", f"FROM '{big}/embeddings.parquet'")
    got, want = pairs(entry.queries()[name](spark, big), sql)
    assert got == want


def test_numbers_over_a_whole_table(spark, tmp_path):
    from meridia.operators.numbering import numbered

    t = spark.range(1000).selectExpr("id", "id * 7919 % 1000 AS k").repartition(7)
    assert {r.id: r.n for r in numbered(t, ["k"], f"{tmp_path}/t").collect()} == {i: i * 7919 % 1000 for i in range(1000)}
    assert numbered(t.limit(0), ["k"], f"{tmp_path}/none").count() == 0


def test_checksums_of_all_files(spark, tmp_path):
    for name in ("a.bin", "t/x.bin", "u/x.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    for d in (D, str(tmp_path)):
        want = sorted((str(p.relative_to(d)), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(d).rglob("*") if p.is_file())
        assert len(want) > 1 and sorted(map(tuple, entry.queries()["SNK-9"](spark, d).collect())) == want


@pytest.mark.parametrize("by_tasks", [True, False])
def test_files_of_rows(spark, tmp_path, monkeypatch, by_tasks):
    """Each row is a file, whatever its name; folders hold many files, and only those of tasks that ended are listed."""
    from meridia.sources import checksums, ranged

    if not by_tasks:
        monkeypatch.setattr(ranged, "writes", lambda folder: False)
    rows = [(f"{i} %/\u00fc=+.7", bytes([i % 256]) * (i % 50)) for i in range(60)] + ([("same", b"a"), ("same", b"a"), ("same", b"bc"), (None, b"x"), ("", b"")] if by_tasks else [])
    monkeypatch.setattr(ranged, "FOLDER_FILES", 10)
    files = ranged.write_files(spark.createDataFrame(rows, "name string, content binary").coalesce(1), f"file://{tmp_path}/a b")
    if by_tasks:
        assert len(list((tmp_path / "a b" / "files").iterdir())) == 7
        (tmp_path / "a b" / "files" / "stray").mkdir()
        (tmp_path / "a b" / "files" / "stray" / "name=cut.0").write_bytes(b"cut short")
    assert sorted(r.length for r in files.collect()) == sorted(len(c) + 1 for _, c in rows)
    if by_tasks:  # else the store isn't one that tasks can read
        want = sorted((str(n), len(c) + 1, hashlib.sha256(c + b"\n").hexdigest()) for n, c in rows)
        for most in (checksums.RANGE, 20):
            got = checksums.of_files(files, most).select(ranged.name_of("path"), "length", "sha256").collect()
            assert sorted((str(n), length, digest) for n, length, digest in got) == want
    assert sorted(str(r[0]) for r in files.select(ranged.name_of("path")).collect()) == sorted(str(n) for n, _ in rows)


def test_files_of_pages_in_a_store_that_only_spark_opens(spark, monkeypatch):
    from meridia.sources import ranged

    monkeypatch.setattr(ranged, "writes", lambda folder: False)
    for name in ("SNK-9.files", "SRC-23"):
        got, want = pairs(entry.queries()[name](spark, D), entry.oracle_sql()[name].replace("FROM pages", f"FROM '{D}/pages.parquet/*.parquet'" if os.path.isdir(f"{D}/pages.parquet") else f"FROM '{D}/pages.parquet'"))
        assert got == want


@pytest.mark.parametrize("name", ["SRC-16.files", "SNK-9.files", "SRC-23"])
def test_files_of_pages(spark, tmp_path, name):
    """Repeated page_ids and none are files of their own, as in the SQL; tasks are far fewer than files."""
    rows = [(i, f"u{i}", f"<p>\u00e9 {i}\n</p>" * (i % 7)) for i in range(400)] + [(7, "u", "again"), (7, "u", "<p>"), (None, "u", "no id")]
    pages = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(pages)
    want = duckdb.sql(entry.oracle_sql()[name].replace("FROM pages", f"FROM '{pages}/*.parquet'")).fetchall()
    tracker, group = spark.sparkContext.statusTracker(), f"files {name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = entry.queries()[name](spark, str(tmp_path)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert 0 < sum(s.numTasks for s in stages if s) < 50


def test_checksums_by_ranges(spark, tmp_path):
    """Lengths around the ranges' ends; no turn reads more of a file than a range, and a file is read once."""
    from meridia import sources
    from meridia.sources import checksums

    rng = __import__("random").Random(3)
    for n in (1, 999, 1000, 1001, 2000, 2001, 4567, 10_000):
        (tmp_path / f"t{n % 3}").mkdir(exist_ok=True)
        (tmp_path / f"t{n % 3}" / f"{n} %.bin").write_bytes(rng.randbytes(n))
    want = sorted((str(p.relative_to(tmp_path)), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*.bin"))
    assert sorted(map(tuple, sources.artefacts(spark, str(tmp_path), most=1000).collect())) == want
    path, at, state, read = str(tmp_path / "t1" / "10000 %.bin"), 0, None, []
    while at < 10_000:
        before = at
        at, state, found = checksums._further(path, 10_000, at, state, 1000)
        read.append(at - before)
    assert read == [1000] * 10 and (path.rsplit("/", 1)[1], found) in [(n.rsplit("/", 1)[1], h) for n, _, h in want]


def test_zeros_keep_their_sign(spark, tmp_path):
    """Small vectors, of which many components round to -0.0, digit for digit as in the SQL."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(5).normal(size=(500, 64)).astype(np.float32) * np.float32(3e-5)
    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(500), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(np.arange(500) % 7, pa.int32())}), path)
    wrong = []
    for name in ("AGG-22", "SMP-7", "RET-10", "VEC-6", "SRC-8"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
        cur = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        want = sorted(repr(r) for r in cur.fetchall())
        assert any("-0.0," in r for r in want)
        if sorted(repr(tuple(r)) for r in entry.queries()[name](spark, str(tmp_path)).select(*names).collect()) != want:
            wrong.append(name)
    assert not wrong


@pytest.mark.parametrize("name", ["AGG-22", "JOIN-16", "RET-10"])
def test_large_numbers_are_rounded_as_in_the_sql(spark, tmp_path, name):
    """Whole components from 1e9 to 1e15, whose sums are exact: times a million they pass 2 to the 52nd, and the way back costs a digit."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(11)
    x = np.round(rng.choice([-1, 1], (500, 64)) * 10 ** rng.uniform(9, 15, (500, 64))).astype(np.float32)
    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(500), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(np.arange(500) % 7, pa.int32())}), path)
    got, want = pairs(entry.queries()[name](spark, str(tmp_path)), entry.oracle_sql()[name].replace("FROM embeddings", f"FROM '{path}'"))
    assert want and got == want


def test_mel_bands_keep_the_sign_of_zero(spark, tmp_path):
    """A single sample in each recording, so strong that one of its bands is just below 0 dB and rounds to -0.0."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    edges = 700 * (10 ** (np.arange(18) * (2595 * np.log10(1 + 4000 / 700)) / 17 / 2595) - 1)
    hz = np.arange(33)[:, None] * 125.0
    weights = np.clip(np.minimum((hz - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - hz) / np.diff(edges)[1:]), 0, None).sum(axis=0)
    bands = np.flatnonzero(weights > 0)
    x = np.zeros((25 * len(bands), 64), np.float32)
    x[25 * np.arange(len(bands)) + 8, 9] = np.sqrt((1 - 5e-6) / weights[bands])
    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), path)
    got, want = pairs(entry.queries()["VEC-16"](spark, str(tmp_path)), entry.oracle_sql()["VEC-16"].replace("FROM embeddings", f"FROM '{path}'"))
    assert sum("-0.0," in r or "-0.0]" in r for r in want) >= len(bands) and got == want


def test_a_direction_has_the_norm_of_its_centroid(spark):
    """One dimension and a power of two: multiplied before it is divided, as in the SQL, no digit is lost."""
    from meridia.operators.rerank import isotropic

    found = {abs(r.centroid[0]) for r in isotropic(spark.range(300).selectExpr("id ref_id", "1L artist", "array(1024D) centroid")).collect()}
    assert found == {1024.0}
