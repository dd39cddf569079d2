"""Core functions and operators against hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia import sources
from meridia.functions import stats, strings, vectors
from meridia.operators import audit, calibrate, compare, metrics, rerank, retrieval, sampling


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(("b", "c", "p"), [(12, 48, 3.183628737933597e-06), (17, 39, 0.0045615327464082), (0, 17, 1.52587890625e-05), (0, 0, 1.0), (5, 5, 1.0), (900, 1100, None)])
def test_mcnemar(spark, b, c, p):
    got = one(spark.range(1).select(stats.mcnemar_exact(F.lit(b), F.lit(c)).alias("p")))["p"]
    n = b + c
    exact = min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(b, c) + 1))) if n else 1.0
    assert got == pytest.approx(exact, rel=1e-8)
    if p is not None:
        assert got == pytest.approx(p, rel=1e-8)


@pytest.mark.parametrize(("k", "n"), [(0, 0), (0, 1000), (500, 1000), (999, 1000), (1000, 1000)])
def test_wilson(spark, k, n):
    low, high = stats.wilson(F.lit(k), F.lit(n))
    got = one(spark.range(1).select(low.alias("low"), high.alias("high")))
    if n == 0:
        assert (got["low"], got["high"]) == (0, 0)
    else:
        p, z = k / n, 1.96
        centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
        assert got["low"] == pytest.approx(max(0, centre - half)) and got["high"] == pytest.approx(min(1, centre + half))


def _answers(spark):
    manifest = spark.createDataFrame([(1, "a", "x", 1.0), (2, "b", "x", 2.0), (3, "c", "y", 3.0), (4, None, "y", 0.0)], "query_id long, ref_id string, corpus string, offset_sec double")
    rows = [(1, 1, "a", 1.25, 0.0), (2, 1, "z", 0.0, 0.0), (2, 2, "b", 2.0, 0.0), (3, 0, None, None, None), (4, 1, None, 0.0, 0.0)]
    return spark.createDataFrame(rows, "query_id long, rank int, predicted_ref_id string, ref_start double, query_start double"), manifest


def test_scorecard(spark):
    results, manifest = _answers(spark)
    card = {(r["grouping"], r["value"]): r for r in metrics.scorecard(results, manifest, "corpus").collect()}
    total = card["all", "all"]
    assert (total["n"], total["hits"], total["no_match"]) == (4, 1, 1)  # a null answer never equals a null truth
    assert total["hr_1"] == 0.25 and total["hr_5"] == 0.5 and total["mrr_10"] == pytest.approx(1.5 / 4)
    assert card["corpus", "x"]["n"] + card["corpus", "y"]["n"] == 4
    assert one(metrics.alignment(results, manifest))["median"] == pytest.approx(0.25)


def test_empty_results(spark):
    results, manifest = _answers(spark)
    assert one(metrics.scorecard(results.limit(0), manifest))["frac_no_match"] == 1.0
    assert one(metrics.alignment(results.limit(0), manifest))["median"] is None


def test_knn_and_sequences(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=(60, 8))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    lib = spark.createDataFrame([(i, i // 20, [float(x) for x in v]) for i, v in enumerate(e)], "global_idx long, ref_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(7, j, [float(x) for x in e[25 + j]]) for j in range(3)], "query_id long, q_off long, embedding array<double>")
    got = {(r.q_off, r["rank"]): r.global_idx for r in retrieval.knn(q, lib, 5).collect()}
    for j in range(3):
        ip = np.round(e @ e[25 + j], 6)
        assert [got[j, r] for r in range(1, 6)] == sorted(range(60), key=lambda i: (-ip[i], i))[:5]
    best = retrieval.sequence_search(q, lib, k_probe=5, k=3).where("rank = 1").first()
    assert (best.cand, best.score) == (25, 1.0)
    assert retrieval.sequence_search(q, lib, k_probe=60, within_ref=True, k=100).where("cand in (18, 19, 38, 39)").count() == 0


def test_votes(spark):
    q = spark.createDataFrame([(1, "h1", 0), (1, "h2", 1), (1, "h2", 1)], "query_id long, hash string, t long")
    r = spark.createDataFrame([(5, "h1", 10), (5, "h2", 11), (6, "h2", 4), (6, "h1", 9)], "ref_id long, hash string, t long")
    rows = retrieval.best_per_ref(retrieval.hash_votes(q, r)).orderBy("rank").collect()
    assert [(x.ref_id, x["shift"], x.votes) for x in rows] == [(5, 10, 2), (6, 3, 1)]


def test_compare(spark):
    a = spark.createDataFrame([(i, i < 6) for i in range(10)], "query_id long, hit boolean")
    b = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "query_id long, hit boolean")
    assert {r.kind: r.n for r in compare.flips(a, b).collect()} == {"common_hit": 3, "broken": 3, "fixed": 2, "common_miss": 2}
    assert one(compare.across_seeds(a.union(b), a))["persistent_misses"] == 2


def test_controls_keep_norm_and_change_artist(spark):
    lib = spark.createDataFrame([(i, i // 3, (i // 3) % 3, [float(i % 5 + 1), 2.0, float(i)]) for i in range(27)], "global_idx long, ref_id long, artist long, embedding array<double>")
    loo = rerank.leave_one_out(lib)
    own = {r.ref_id: r.centroid for r in loo.collect()}
    for r in rerank.isotropic(loo).collect():
        assert np.linalg.norm(r.centroid) == pytest.approx(np.linalg.norm(own[r.ref_id]))
    artist = {r.ref_id: r.artist for r in loo.collect()}
    for r in rerank.shuffled(loo).collect():
        assert any(c == r.centroid and artist[k] != r.artist for k, c in own.items())


def test_threshold_rule(spark):
    neg = spark.createDataFrame([(i / 100,) for i in range(100)], "score double")
    assert one(calibrate.threshold(neg))["threshold"] == pytest.approx(0.95 + 1e-6)
    assert one(calibrate.threshold(neg, exact=True))["threshold"] == pytest.approx(0.94 + 1e-6)
    assert one(calibrate.threshold(neg.limit(10)))["threshold"] == pytest.approx(0.09 + 1e-6)


def test_roc_counts(spark):
    pos, neg = (spark.createDataFrame([(x,) for x in v], "score double") for v in ([0.9, 0.5, 1.0], [0.1, 0.5]))
    got = {round(r.threshold, 3): (r.tpr, r.fpr) for r in calibrate.roc(pos, neg, 10).collect()}
    assert got[0.5] == (1.0, 0.5) and got[0.6] == (pytest.approx(2 / 3), 0.0) and got[1.0] == (pytest.approx(1 / 3), 0.0)


def test_overlaps_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), i, float(s), float(s + w)) for i, (k, s, w) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 200, 80), rng.integers(1, 60, 80), strict=True))]
    t = spark.createDataFrame(rows, "k long, id long, start double, stop double")
    got = {(r.a_id, r.b_id) for r in audit.overlaps(t, t, "k", 25.0).collect()}
    assert got == {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}


def test_twins(spark):
    t = spark.createDataFrame([(1, ["k", "k"]), (2, ["k"]), (3, ["m"]), (4, None)], "id long, keys array<string>")
    assert audit.twins(t, "id", "keys").count() == 2
    assert {r.id: r.has_twin for r in audit.has_twin(t, "id", "keys").collect()} == {1: True, 2: True, 3: False, 4: False}


def test_samples_are_repeatable(spark):
    t = spark.range(100).withColumn("s", F.col("id") % 3)
    a, b = (sorted(r.id for r in sampling.uniform_sample(x, "id", 10).collect()) for x in (t, t.repartition(7)))
    assert a == b and len(set(a)) == 10
    per = [r["count"] for r in sampling.stratified_sample(t, "id", "s", 10).groupBy("s").count().collect()]
    assert max(per) - min(per) <= 1


def test_windows_and_strings(spark):
    row = one(
        spark.range(1).select(
            F.size(vectors.windows(F.array(*[F.lit(float(i)) for i in range(10)]), 4, 2)).alias("n"), F.size(vectors.windows(F.array(F.lit(1.0)), 4, 2)).alias("none"),
            strings.canonical_key(F.lit(" B;a ; b;;")).alias("key"), strings.canonical_key(F.lit("nan")).alias("unknown"), strings.classify(F.lit("Ṭāni in ālāp"), strings.SECTION_RULES).alias("kind"),
        )
    )
    assert row == {"n": 4, "none": 0, "key": "a;b", "unknown": "__UNKNOWN__", "kind": "tani"}


def test_lines(spark):
    good = "1 ; 2 ; q.wav ; 0 ; 3 ; r.mp3 ; 77 ; 1.5 ; 4.5 ; 12 ; 1.0 % ; 1.0 % ; 88.5 %"
    t = spark.createDataFrame([(good,), ("1 ; 2",), (good.replace("12", "many"),), (None,), (good.replace("1 ; 2", "x ; 2"),), ("q " + good,), (good.replace("1.5", "?"),), (good + " ; more",)], "line string")
    rows = [r for r in t.select(*[c.alias(k) for k, c in strings.match_line(F.col("line")).items()]).dropna().collect()]
    assert len(rows) == 2 and rows[0].match_count == 12 and rows[0].ref_path == 'r.mp3' and rows[0].seconds_with_match_pct == 88.5


def test_sources(spark, tmp_path):
    t = spark.createDataFrame([("a", float("nan")), ("b", 2.0)], "ref_id string, duration_sec double")
    sources.write_csv(t, str(tmp_path / "csv"))
    schema = type(sources.REFS)([sources.REFS["ref_id"], sources.REFS["duration_sec"]])
    assert {r.ref_id: r.duration_sec for r in sources.read_csv(spark, str(tmp_path / "csv"), schema).collect()} == {"a": None, "b": 2.0}
    assert sources.read_results(spark, str(tmp_path / "nothing"), split="main").count() == 0
    good, bad = sources.split_valid(t, odd=F.isnan("duration_sec"))
    assert good.count() == 1 and bad.first().reasons == ["odd"]


def test_rounded_keeps_the_sign_of_zero(spark):
    import duckdb

    values = [-2e-7, 2e-7, -0.0, 0.0, -5e-7, 5e-7, 1.0000005, -0.0123455, 0.49999999999999994e-6, 2.0**60, -1e300, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", stats.rounded(F.col("x"), 6).alias("r")).orderBy("i").select("r").collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want)) and repr(got[0]) == "-0.0"
