"""Cells and exports, reports, cuts and rates, sections, and the contract of systems."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia import sources
from meridia.functions import variants
from meridia.operators import matcher, signals
from meridia.plans import exports, fixtures, registry
from meridia.sources import cells, media

D = "/root/testdata/sf0.001"


def test_names_of_cells():
    assert cells.cell_of("main_3s") == ("main", 3) and cells.cell_of("ablation_10s") == ("ablation", 10)
    for bad in ("main_3", "other_3s", "main_s", ""):
        with pytest.raises(ValueError):
            cells.cell_of(bad)


def test_only_asked_runs_are_read(spark, tmp_path):
    folder = f"{tmp_path}/runs"
    rows = [("a", "main", 3, s, q) for s in (1, 2) for q in range(5)] + [("a", "ablation", 3, 1, 9), ("b", "main", 3, 0, 7)]
    cells.write_runs(spark.createDataFrame(rows, "system string, split string, length_s int, seed int, query_id int"), folder)
    (tmp_path / "runs" / "system=b" / "split=main" / "length_s=3" / "seed=0").joinpath("part-broken.parquet").write_bytes(b"no parquet")
    table, missing = cells.read_runs(spark, folder, [("a", "main_3s", 1), ("a", "main_5s", 1), ("c", "main_3s", 1)])
    assert table.count() == 5 and set(table.columns) == {"system", "split", "length_s", "seed", "query_id"}
    assert missing == [("a", "main_5s", 1), ("c", "main_3s", 1)]
    assert cells.read_runs(spark, folder, [("c", "main_3s", 1)])[0] is None
    done = cells.export(spark, {"x": f"{folder}/system=a/split=main", "y": f"{folder}/nothing"}, f"{tmp_path}/out")
    assert sorted(map(tuple, done.collect())) == [("x", "copied", 10), ("y", "missing", None)]
    assert spark.read.parquet(f"{tmp_path}/out/x").count() == 10


def test_reports(spark, tmp_path):
    t = spark.createDataFrame([("b", 2, 0.5), ("a", 10, None), ("a", 9, 0.25)], "k string, n long, share double")
    lines = [r.line for r in cells.markdown(t, "Title", {"k": "%s", "n": "%d", "share": "%.2f"}, ["k", "n"]).orderBy("place").collect()]
    assert lines == ["# Title", "", "| k | n | share |", "|---|---|---|", "| a | 9 | 0.25 |", "| a | 10 | - |", "| b | 2 | 0.50 |"]
    cells.write_json(t, f"{tmp_path}/one")
    cells.write_json(t, f"{tmp_path}/two", "k")
    got = cells.read_json(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], "n long, share double")
    assert got.count() == 6 and got.where("n = 10 and share is null").count() == 2 and got.where(F.col("path").contains("k=a")).count() == 2
    assert sources.read_lines(spark, f"{tmp_path}/one").count() == 3


def test_cuts_over_chunks(spark):
    x = [float(i) for i in range(205)]
    chunks = spark.createDataFrame([("a", i, x[i : i + 20]) for i in range(0, 205, 20)] + [("b", 0, [7.0])], "clip_id string, at long, samples array<double>")
    asked = {"whole": ("a", 0, 205), "inside": ("a", 43, 9), "across": ("a", 19, 62), "end": ("a", 200, 99), "one": ("b", 0, 5), "none": ("a", 10, 0), "beyond": ("a", 500, 5), "absent": ("c", 0, 5), "before": ("a", -5, 10)}
    q = spark.createDataFrame([(k, *v) for k, v in asked.items()], "query_id string, clip_id string, start long, length long")
    got = {r.query_id: r.samples for r in signals.cut(chunks, q, 20).collect()}
    assert got == {"whole": x, "inside": x[43:52], "across": x[19:81], "end": x[200:], "one": [7.0]}


def test_another_rate(spark):
    at = np.arange(2000)
    low, high = np.sin(2 * np.pi * 300 * at / 8000), np.sin(2 * np.pi * 3500 * at / 8000)
    t = spark.createDataFrame([("low", low.tolist()), ("high", high.tolist()), ("none", []), ("null", None)], "k string, samples array<double>")
    half = {r.k: r.samples for r in signals.resample(t, 8000, 4000).collect()}
    assert half["none"] == [] and half["null"] is None and len(half["low"]) == 1000
    assert np.allclose(half["low"][50:-50], np.sin(2 * np.pi * 300 * np.arange(1000) / 4000)[50:-50], atol=0.01)
    assert np.abs(half["high"][50:-50]).max() < 0.02  # above the new band
    up = {r.k: r.samples for r in signals.resample(t, 8000, 12000).collect()}
    assert np.allclose(up["low"][60:-60], np.sin(2 * np.pi * 300 * np.arange(3000) / 12000)[60:-60], atol=0.01)
    same = {r.k: r.samples for r in signals.resample(t, 8000, 8000).collect()}
    assert np.allclose(same["low"], low, atol=1e-12)
    with pytest.raises(ValueError):
        signals.resample(t, 8000, 0)


def test_widths_of_samples(spark):
    import io
    import wave

    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.75])
    files = []
    for width in (1, 2, 3, 4):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(100)
            whole = (np.repeat(x, 2) * 2 ** (8 * width - 1)).astype(np.int64)
            w.writeframes(b"".join(int(v + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) for v in whole))
        files.append((str(width), bytearray(out.getvalue())))
    got = {r.path: r for r in media.decode_wav(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert all(r.channels == 2 and np.allclose(r.samples, x) for r in got.values()) and len(got) == 4


def test_sections_of_two_forms(spark):
    rows = {
        '{"intervals": [[0, 1.5], [2, 3]], "labels": ["a"]}': [(0, 1.5, "a"), (2, 3, None)], '[{"time": 1, "duration": 2, "value": "x"}, {"time": 4}]': [(1, 3, "x"), (4, 4, None)],
        "[]": [], "{}": [], "null": [], "5": [], "no": [],
    }
    t = spark.createDataFrame([(k,) for k in rows], "j string").select("j", variants.sections(variants.parse(F.col("j"))).alias("s"))
    assert {r.j: [tuple(x) for x in r.s or []] for r in t.collect()} == rows


def test_contract(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    kinds = "query_id string, rank int, predicted_ref_id string, score double, ref_start double"
    good = [("a", 1, "x", 0.9, 0.0), ("a", 2, "y", 0.9, 1.0), ("b", 0, None, None, None), ("c", 1, "x", 0.1, None)]
    frame = lambda rows: spark.createDataFrame(rows, kinds)
    out = matcher.run({"one": lambda: frame(good), "two": lambda: matcher.with_no_match(frame(good[:2]), queries)}, queries)
    assert sorted((r.system, r.query_id, r["rank"]) for r in out.collect()) == [("one", "a", 1), ("one", "a", 2), ("one", "b", 0), ("one", "c", 1), ("two", "a", 1), ("two", "a", 2), ("two", "b", 0), ("two", "c", 0)]
    bad = {
        "queries without a row": good[:3], "unknown queries": [*good, ("z", 1, "x", 1.0, 0.0)], "ranks missing or repeated": [*good, ("c", 1, "y", 0.1, 0.0)],
        "answers of rank 0, or ranks without one": [*good[:3], ("c", 1, None, 0.1, 0.0)], "scores that rise": [*good, ("c", 2, "y", 0.2, 0.0)],
    }
    for what, rows in bad.items():
        assert what in matcher.faults(frame(rows), queries)
        with pytest.raises(matcher.BrokenContract, match=what):
            matcher.run({"bad": lambda rows=rows: frame(rows)}, queries)
    with pytest.raises(matcher.BrokenContract, match="lacks score"):
        matcher.run({"bad": lambda: frame(good).drop("score")}, queries)


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the generated tables")
def test_results_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "LINES", 700)
    lines = registry.table(spark, D, "lineitem").count()
    runs = exports._runs(spark, D)
    most = runs.groupBy("system", "seed", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert lines > 3000 and most < 1000  # whatever spark.sql.shuffle.partitions says
