"""Quantiles, numbers, kNN tiles, stored hashes, landmarks and written indexes against plain NumPy and Python."""

import itertools
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.operators import hash_store, landmarks, quantiles, rerank, vector_index
from meridia.operators import retrieval as R
from meridia.operators.numbering import numbered

# quantiles


def column(spark, values):
    return spark.createDataFrame([(v, "x") for v in values], "v double, w string").repartition(5)


@pytest.mark.parametrize("few", [0, quantiles.FEW])
def test_quantiles_of_odd_values(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 16)
    rng = random.Random(1)
    cases = [
        [], [None], [3.5], [1.0, 2.0], [2.0] * 50 + [None] * 9, [1e300, -1e300, 0.0, 1e-300, -1e-300, 5e-324],
        [math.inf, -math.inf, 1.0, 2.0, math.inf], [rng.lognormvariate(0, 8) for _ in range(500)] + [7.0] * 300,
    ]
    for values in cases:
        have = sorted(v for v in values if v is not None)
        t = column(spark, values)
        places = [-1, 0, 1, len(have) // 2, len(have) - 1, len(have)]
        assert quantiles.order_statistics(t, "v", places) == [have[p] if 0 <= p < len(have) else None for p in places]
        finite = [v for v in have if abs(v) < math.inf]
        if finite == have and have:
            got = quantiles.quantiles(t, "v", 0.0, 0.05, 0.5, 0.95, 1.0)
            want = t.agg(F.percentile("v", F.array(*[F.lit(s) for s in (0.0, 0.05, 0.5, 0.95, 1.0)]))).first()[0]
            assert got == pytest.approx(want, rel=1e-12)
    nan = column(spark, [math.nan, 1.0, 2.0, math.nan])
    low, high, first_nan = quantiles.order_statistics(nan, "v", [0, 1, 2])
    assert (low, high) == (1.0, 2.0) and math.isnan(first_nan)


def test_quantiles_of_a_million_values(spark):
    t = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003 / 1000).alias("v"))
    want = np.sort(np.arange(1_000_000) * 7919 % 1_000_003 / 1000)
    assert quantiles.quantiles(t, "v", 0.5, 0.95, 0.99) == pytest.approx(np.quantile(want, [0.5, 0.95, 0.99]).tolist(), rel=1e-12)


def test_sums_before(spark, tmp_path):
    t = spark.range(1000).selectExpr("id", "id * 7919 % 1000 AS k", "CASE WHEN id % 9 > 0 THEN id % 5 END AS size").repartition(7)
    by_k = sorted((r.k, r.size or 0) for r in t.collect())
    before = dict(zip((k for k, _ in by_k), itertools.accumulate((s for _, s in by_k), initial=0), strict=False))
    got = numbered(t, ["k"], f"{tmp_path}/t", "n", base="size").collect()
    assert len(got) == 1000 and all(r.n == r.k and r.base == before[r.k] for r in got)


# kNN and re-ranking


def unit(rng, n, d=8):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("tiles", [(8192, 32768, 256), (7, 40, 10)])
def test_knn_over_tiles(spark, monkeypatch, tiles):
    for name, value in zip(("QUERY_TILE", "LIBRARY_TILE", "LEAST_TILE"), tiles, strict=True):
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(2)
    lib, q = unit(rng, 300), unit(rng, 20)
    lib[100:130] = lib[5]  # ties
    q[3] = lib[5]
    library = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(lib)], "global_idx long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{i % 10}", i // 10, v.tolist()) for i, v in enumerate(q)], "query_id string, q_off int, embedding array<double>")
    ip = np.round(q @ lib.T, 6)
    want = {(f"q{i % 10}", i // 10, int(j), r + 1) for i in range(20) for r, j in enumerate(np.lexsort((np.arange(300), -ip[i]))[:7])}
    assert {(r.query_id, r.q_off, r.global_idx, r["rank"]) for r in R.knn(queries, library, 7).collect()} == want
    assert R.knn(queries.limit(0), library, 7).count() == 0 and R.knn(queries, library.limit(0), 7).count() == 0
    assert R.knn(queries, library, 1000).count() == 20 * 300


def test_shuffled_donors_are_of_other_artists(spark, tmp_path):
    rows = [(i, "hot" if i < 30 else f"a{i % 4}", [float(i)]) for i in range(60)]
    got = rerank.shuffled(spark.createDataFrame(rows, "ref_id long, artist string, centroid array<double>"), f"{tmp_path}/p").collect()
    artist = {r[0]: r[1] for r in rows}
    assert len(got) == 60 and all(artist[r.donor] != r.artist and r.centroid == [float(r.donor)] for r in got)
    assert len({r.donor for r in got}) > 25  # a donor for each recording, not for each artist
    alone = rerank.shuffled(spark.createDataFrame(rows[:3], "ref_id long, artist string, centroid array<double>"), f"{tmp_path}/q").collect()
    assert [r.centroid for r in alone] == [None] * 3


def test_sweep_is_the_moved_product(spark):
    rng = np.random.default_rng(3)
    lib, q, mu = unit(rng, 12), unit(rng, 2), {k: 0.4 * unit(rng, 3) for k in ("own", "shuffled", "isotropic")}
    library = spark.createDataFrame([(i, i // 4, v.tolist()) for i, v in enumerate(lib)], "global_idx long, ref_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, i, v.tolist()) for i, v in enumerate(q)], "query_id long, q_off long, embedding array<double>")
    cands = spark.range(11).select(F.lit(7).cast("long").alias("query_id"), F.col("id").alias("cand"))
    tables = {k: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "ref_id long, centroid array<double>") for k, m in mu.items()}
    got = {(r.variant, r.cand): r.score for r in rerank.sweep(cands, queries, library, tables, k=100).collect()}
    assert len(got) == 9 * 11
    for name, kind, alpha in rerank.variants():
        moved = lib - alpha * mu[kind][np.arange(12) // 4]
        moved /= np.linalg.norm(moved, axis=1, keepdims=True)
        for c in range(11):
            assert got[name, c] == pytest.approx(np.mean([q[i] @ moved[c + i] for i in range(2)]), abs=2e-6)


# stored hashes


def brute_votes(queries, stored):
    out = Counter()
    for q, h, t in set(queries):
        out.update((q, r, rt - t) for r, rh, rt in set(stored) if rh == h)
    return out


def test_hash_store(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", rng.choice([1, 1, 1, *range(2, 30)]), rng.randrange(40)) for i in range(20) for _ in range(30)]
    refs = [(f"r{i}", "m" * (31 if i == 3 else 32), float(i % 7)) for i in range(20)] + [("silent", "s" * 32, 1.0), (None, "n" * 32, 1.0), ("r5", "m" * 32, 0.0)]
    kinds = "ref_id string, source_md5 string, duration_sec double", "ref_id string, hash long, t long"
    frames = lambda keep: (spark.createDataFrame([r for r in refs if keep(r[0])], kinds[0]), spark.createDataFrame([r for r in rows if keep(r[0])], kinds[1]))
    store = hash_store.create(spark, frames(lambda r: True)[0], buckets=4)
    early = lambda r: r in {"r1", "r2", "r3", "r9"}
    hash_store.insert(store, *frames(early))
    assert {r.ref_id: r.song_id for r in store.songs().collect()} == {"r2": 1, "r9": 2, "r1": 3}
    for _ in range(2):  # the second time changes nothing
        hash_store.insert(store, *frames(lambda r: True))
    songs = {r.ref_id: (r.song_id, r.n_hashes) for r in store.songs().collect()}
    good = [r for r in rows if r[0] != "r3"]
    assert {k: n for k, (_, n) in songs.items()} == Counter(r for r, _, _ in set(good))
    assert [songs[r][0] for r in ("r2", "r9", "r1")] == [1, 2, 3] and sorted(s for s, _ in songs.values()) == list(range(1, 20))
    assert {tuple(r) for r in store.hashes().collect()} == set(good) and store.hashes().count() == len(set(good))
    assert {tuple(r) for r in store.failures().collect()} == {("r3", hash_store.MISSING_MD5), ("silent", hash_store.NO_HASHES)}
    queries = [("q", rng.choice([1, 5, 6]), rng.randrange(9)) for _ in range(12)]
    q = spark.createDataFrame(queries, "query_id string, hash long, t long")
    assert {(r.query_id, r.ref_id, r["shift"]): r.votes for r in hash_store.votes(store, q).collect()} == brute_votes(queries, good)
    hash_store.drop(store)


def test_an_insert_writes_hashes_once(spark):
    refs = spark.createDataFrame([("a", "m" * 32, 1.0)], "ref_id string, source_md5 string, duration_sec double")
    rows = spark.range(50).select(F.lit("a").alias("ref_id"), (F.col("id") % 40).alias("hash"), (F.col("id") % 40).alias("t"))  # ten are repeated
    store = hash_store.create(spark, refs, buckets=2)
    hash_store.insert(store, refs, rows)
    assert [(r.song_id, r.n_hashes) for r in store.songs().collect()] == [(1, 40)] and store.hashes().count() == 40
    (fresh,) = Path(store.folder.removeprefix("file://")).glob("insert-*")
    assert not {"hashes", "rows"} & {p.name for p in fresh.iterdir()}
    assert hash_store.buckets_for(10) == hash_store.BUCKETS and hash_store.buckets_for(10**9) == 667
    hash_store.drop(store)


def test_an_insert_cut_short(spark):
    """Ids are there, hashes are not or in part: no votes until it is sent again, and others get other ids."""
    refs = spark.createDataFrame([("a", "m" * 32, 9.0)], "ref_id string, source_md5 string, duration_sec double")
    store = hash_store.create(spark, refs, buckets=4)
    store._append("songs", spark.createDataFrame([(1, "a", "m" * 32, 0)], "song_id long, ref_id string, source_md5 string, n_hashes long"))
    part = spark.createDataFrame([(5, 1, 3)], "hash long, song_id long, t long").select("hash", F.pmod(F.xxhash64("song_id"), F.lit(hash_store.PARTS)).cast("int").alias("part"), "song_id", "t")
    store._append("hashes", part)
    query = spark.createDataFrame([("q", 5, 0)], "query_id string, hash long, t long")
    hashes = spark.createDataFrame([("a", 5, 3), ("a", 6, 4)], "ref_id string, hash long, t long")
    other = spark.createDataFrame([("b", "m" * 32, 1.0)], refs.schema)
    hash_store.insert(store, other, hashes.withColumn("ref_id", F.lit("b")))
    assert [(r.ref_id, r.votes) for r in hash_store.votes(store, query).collect()] == [("b", 1)]
    hash_store.insert(store, refs, hashes)
    assert sorted((r.song_id, r.ref_id, r.n_hashes) for r in store.songs().collect()) == [(1, "a", 2), (2, "b", 2)]
    assert store.hashes().count() == 4 and hash_store.votes(store, query).count() == 2
    hash_store.drop(store)


def test_votes_leave_the_library_in_place(spark):
    refs = spark.createDataFrame([("a", "m" * 32, 9.0)], "ref_id string, source_md5 string, duration_sec double")
    store = hash_store.create(spark, refs, buckets=4)
    hash_store.insert(store, refs, spark.range(100).select(F.lit("a").alias("ref_id"), F.col("id").alias("hash"), F.col("id").alias("t")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        q = spark.createDataFrame([("q", 5, 0)], "query_id string, hash long, t long")
        plan = hash_store.votes(store, q)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "_hashes" in line)
    above = [lines[at]]  # from the scan up to the join
    for line in reversed(lines[:at]):
        if depth(line) < depth(above[-1]):
            above.append(line)
        if "Join" in above[-1]:
            break
    assert "Bucketed: true" in above[0] and "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above)


# signals


def signal(rng, n):
    """Sums of sines that come and go."""
    at = np.arange(n)
    parts = [(rng.uniform(200, 3800), rng.uniform(0.2, 1), rng.uniform(0, n), rng.uniform(200, 900)) for _ in range(12)]
    return sum(a * np.sin(2 * np.pi * f * at / 8000) * np.exp(-(((at - c) / w) ** 2)) for f, a, c, w in parts)


def chunked(spark, clips, size):
    rows = [(name, i, x[i : i + size].tolist()) for name, x in clips.items() for i in range(0, len(x), size)]
    return spark.createDataFrame(rows, "clip_id string, at long, samples array<double>").repartition(4)


@pytest.mark.parametrize(("tile", "size"), [(1024, 5000), (7, 50), (20, 333)])
def test_landmarks(spark, tile, size):
    rng = np.random.default_rng(5)
    clips = {"long": signal(rng, 6000), "short": signal(rng, 400), "none": signal(rng, 63), "one": signal(rng, 64)}
    frames = landmarks.Frames(64, 32, tile)
    spectra = {}
    for name, x in clips.items():
        cut = [x[i : i + 64] for i in range(0, len(x) - 63, 32)]
        j = np.arange(64)
        spectra[name] = np.array([[abs((c * np.exp(-2j * np.pi * b * j / 64)).sum()) for b in range(33)] for c in cut]).reshape(-1, 33)
    got = landmarks.spectrogram(chunked(spark, clips, size), frames).collect()
    assert len(got) == sum(map(len, spectra.values()))
    assert all(np.allclose(r.magnitudes, spectra[r.clip_id][r.frame], atol=1e-9) for r in got)
    want = {}
    for name, s in spectra.items():
        s = np.round(s, 6)
        want[name] = [(k, b) for k in range(len(s)) for b in range(33) if 0 < s[k, b] >= s[max(0, k - 15) : k + 16, max(0, b - 3) : b + 4].max()]
    found = landmarks.peaks(chunked(spark, clips, size), frames)
    assert sorted((r.clip_id, r.frame, r.bin) for r in found.collect()) == sorted((n, k, b) for n, p in want.items() for k, b in p)
    pairs, threes = Counter(), Counter()
    for name, p in want.items():
        for i, (k, b) in enumerate(p):
            near = [x for x in p[i + 1 : i + 5] if x[0] - k <= 20]
            pairs.update((name, b << 23 | y << 14 | t - k, k) for t, y in near[:3])
            threes.update((name, (y - b + 512) << 20 | (z - y + 512) << 10 | min(63, (t - k) * 64 // (u - k)), k) for (t, y), (u, z) in itertools.combinations(near, 2) if u > k)
    assert Counter(map(tuple, landmarks.pair_hashes(found, 3, 20).collect())) == pairs
    assert Counter(map(tuple, landmarks.triplet_hashes(found, 4, 20).collect())) == threes
    mel = landmarks.mel_bands(64, 8000.0, 8)
    for r in landmarks.log_mel(chunked(spark, clips, size), 8000.0, 8, frames).where("frame % 9 = 0").collect():
        assert np.allclose(r.mel, 10 * np.log10(np.maximum(spectra[r.clip_id][r.frame] ** 2 @ mel.T, 1e-10)), atol=1e-6)


def test_gaps_are_refused(spark):
    rows = [("a", 0, [0.0] * 64), ("a", 100, [0.0] * 64)]
    with pytest.raises(Exception, match="gaps"):
        landmarks.spectrogram(spark.createDataFrame(rows, "clip_id string, at long, samples array<double>")).collect()


# the index


def test_index_versions(spark, tmp_path):
    rng = np.random.default_rng(6)
    clips = {f"c{i}": signal(rng, n) for i, n in enumerate((1000, 63, 500, 64))}
    signals, folder = chunked(spark, clips, 200), f"{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        vector_index.open_index(spark, folder)
    vectors, reused = vector_index.reuse_or_build(signals, folder)
    n = [(len(x) - 64) // 32 + 1 if len(x) >= 64 else 0 for x in clips.values()]
    rows = sorted(vectors.drop("embedding").collect())
    assert not reused and [r.global_idx for r in rows] == list(range(sum(n)))
    assert [(r.ref_id, r.segment_idx, r.segment_start_sec) for r in rows] == [(f"c{i}", s, s * 0.5) for i, k in enumerate(n) for s in range(k)]
    assert vector_index.reuse_or_build(signals, folder)[1] and vector_index.versions(spark, folder) == {1: True}
    # damaged: one file of the vectors goes
    gone = max((tmp_path / "index" / "version=1" / "vectors").glob("part-*"))
    gone.unlink()
    with pytest.raises(vector_index.DamagedIndex, match="n_segments"):
        vector_index.open_index(spark, folder)
    assert not vector_index.reuse_or_build(signals, folder)[1]
    # cut short: no manifest, so the version before holds
    vector_index.build(signals, folder)
    (tmp_path / "index" / "version=3" / "manifest" / "_SUCCESS").unlink()
    assert vector_index.versions(spark, folder) == {1: True, 2: True, 3: False} and vector_index.manifest(spark, folder)["version"] == 2
    with pytest.raises(vector_index.DamagedIndex, match="components"):
        vector_index.open_index(spark, folder, dim=99)
    # other samples are another index
    assert not vector_index.reuse_or_build(signals.withColumn("samples", F.transform("samples", lambda x: x * 3)), folder)[1]


def test_csls_takes_any_number_of_anchors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(rerank.MOST_ANCHORS + 500, 3))
    lib = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "global_idx long, embedding array<double>")
    queries = spark.createDataFrame([(0, 0, [1.0, 0.0, 0.0]), (1, 0, [0.0, 0.5, 0.5])], "query_id long, q_off long, embedding array<double>")
    scores = spark.createDataFrame([(0, 5, 0.5), (0, 4300, 0.25), (1, 5, 0.75)], "query_id long, cand long, score double")
    got = {(r.query_id, r.cand): r.score for r in rerank.csls(scores, lib.withColumnRenamed("global_idx", "anchor_id"), queries, lib).collect()}
    hood = lambda v: np.sort(np.round(base @ np.array(v), 6))[-10:].mean()
    q = {0: hood([1.0, 0.0, 0.0]), 1: hood([0.0, 0.5, 0.5])}
    assert set(got) == {(0, 5), (0, 4300), (1, 5)}
    for i, c, s in ((0, 5, 0.5), (0, 4300, 0.25), (1, 5, 0.75)):
        assert abs(got[i, c] - (s - (q[i] + hood(base[c])) / 2)) < 2e-6


def test_diagonals_send_a_clip_once_to_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 7)
    monkeypatch.setattr(R, "CLIPS", 2)
    rng = np.random.default_rng(6)
    base, clips = rng.normal(size=(40, 4)), rng.normal(size=(5, 9, 4))
    lib = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base) if i != 20], "global_idx long, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", j, v.tolist()) for i, c in enumerate(clips) for j, v in enumerate(c)], "query_id string, q_off long, embedding array<double>")
    cands = spark.createDataFrame([(f"q{i}", c) for i in range(5) for c in range(-2, 36, 3)], "query_id string, cand long")
    rows = lambda i, c: [(clips[i][j] @ base[c + j]) for j in range(9) if 0 <= c + j < 40 and c + j != 20]
    for whole in (False, True):
        got = R.rescore(cands, q, lib, whole)
        want = {(f"q{i}", c): np.mean(rows(i, c)) for i in range(5) for c in range(-2, 36, 3) if len(rows(i, c)) == 9 or not whole}
        found = {(r.query_id, r.cand): r.score for r in got.collect()}
        assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-6 for k in want)


def test_tiles_sort_each_query_once(monkeypatch):
    """The best of a tile, with ties and rows that are no numbers; blocks of any size give the same, in little memory."""
    import tracemalloc

    rng = np.random.default_rng(3)
    q, base, ids = rng.normal(size=(300, 8)), rng.integers(-1, 2, (5000, 8)).astype(float), rng.permutation(5000)
    q[:200] = np.round(q[:200])
    q[7] = np.nan
    want = []
    for i in range(len(q)):
        ip = np.round(base @ q[i], 6)
        want += [(i, ids[j], ip[j]) for j in np.lexsort((ids, -ip))[:40] if ip[j] == ip[j]]
    for products in (1, 50_000, 4_000_000):
        monkeypatch.setattr(R, "PRODUCTS", products)
        assert list(zip(*R._tile_best(q, ids, base, 40), strict=True)) == want
    monkeypatch.undo()
    q, base = rng.normal(size=(4096, 8)), rng.normal(size=(32_768, 8))
    tracemalloc.start()
    R._tile_best(q, np.arange(len(base)), base, 100)
    assert tracemalloc.get_traced_memory()[1] < 80_000_000
    tracemalloc.stop()
    assert [len(x) for x in R._tile_best(np.full((1, 8), np.nan), np.arange(len(base)), base, 40)] == [0, 0, 0]
