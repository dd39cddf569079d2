"""Encoder gates, components, bootstrap, values of any shape, and streams that stop and go on."""

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia import streaming
from meridia.functions import variants
from meridia.operators import components, gates, resample, vector_index
from meridia.streaming import state


def vectors(spark, rows):
    return spark.createDataFrame([(c, s, [float(x) for x in v]) for (c, s), v in rows.items()], "clip_id long, segment_idx long, embedding array<double>")


def test_encoder_gates(spark):
    rng = np.random.default_rng(1)
    rows = {(c, s): rng.normal(size=16) for c in range(4) for s in range(6)}
    near = {k: v + rng.normal(size=16) * 0.05 for k, v in rows.items()}
    own = vectors(spark, rows)
    good = gates.encoder_gates(own, own, own, vectors(spark, near), require=True).first()
    assert good.passed and good.n == 24 and good.stored_cos == pytest.approx(1) and good.same_cos > 0.9 > good.other_cos
    other = vectors(spark, {k: rng.normal(size=16) for k in rows})
    assert gates.encoder_gates(other, own, own, own).first()[5:] == (False, True, True, False)
    assert gates.encoder_gates(own, own, other, own).first()[5:] == (True, False, True, False)
    flat = vectors(spark, {k: np.ones(16) for k in rows})
    assert gates.encoder_gates(flat, flat, flat, flat).first()[5:] == (True, True, False, False)
    with pytest.raises(Exception, match="fails its gates"):
        gates.encoder_gates(other, own, own, own, require=True).collect()
    less = vectors(spark, {k: v for k, v in rows.items() if k != (1, 1)})
    assert not gates.encoder_gates(less, own, own, own).first().stored_ok
    assert not gates.encoder_gates(*[own.limit(0)] * 4).first().passed


def test_components(spark, tmp_path):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    nodes = spark.range(300).select("id")
    got = {r.id: r.component for r in components.components(nodes, spark.createDataFrame(links, "a long, b long"), f"{tmp_path}/c").collect()}
    assert got == {i: find(i) for i in range(300)}
    none = components.components(nodes.limit(3), spark.createDataFrame([], "a long, b long"), f"{tmp_path}/d")
    assert sorted(map(tuple, none.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_no_component_is_split(spark, tmp_path):
    items = spark.createDataFrame([(i, [f"w{i % 40}"], [f"t{i // 50}"] if i % 3 else []) for i in range(200)], "id long, works array<string>, titles array<string>")
    found = components.components(items, components.star_links(items, "id", "works", "titles"), f"{tmp_path}/c")
    split = {r.id: (r.component, r.held_out) for r in components.held_out(found, 0.5).collect()}
    by_key = {}
    for r in items.collect():
        for k in [*r.works, *r.titles]:
            by_key.setdefault(k, set()).add(split[r.id])
    assert all(len(v) == 1 for v in by_key.values())
    alone = components.held_out(spark.range(2000).select("id", F.col("id").alias("component")), 0.3)
    assert 500 < alone.where("held_out").count() < 700


def test_bootstrap_is_the_loop_over_hashes(spark):
    rng = random.Random(3)
    rows = [(f"q{i}", rng.random() < 0.6, rng.random() < 0.7) for i in range(700)] + [("n", None, True), (None, True, True)]
    pairs = spark.createDataFrame(rows, "query_id string, base_hit boolean, hit boolean").repartition(3)
    known = [(q, bool(x), bool(y)) for q, x, y in rows if q]
    h = np.array([int(hashlib.sha256(f"9:{q}".encode()).hexdigest()[:13], 16) % resample.PRIME for q, _, _ in known])
    a, b = resample.multipliers(200, 9)
    x, y, deltas = np.array([k[1] for k in known]), np.array([k[2] for k in known]), []
    for r in range(200):
        weight = np.searchsorted(resample.poisson_steps(), (h * a[r] + b[r]) % resample.PRIME, side="right")
        deltas.append((weight[y].sum() - weight[x].sum()) / weight.sum())
    got = resample.paired_bootstrap(pairs, 200, 0.9, 9).first()
    assert (got.n, got.replicates) == (701, 200) and got.delta == pytest.approx((y.sum() - x.sum()) / 701)
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(deltas, [0.05, 0.95])))
    steps = np.searchsorted(resample.poisson_steps(), np.arange(0, resample.PRIME, 1000), side="right")
    assert steps.mean() == pytest.approx(1, abs=1e-3) and steps.var() == pytest.approx(1, abs=1e-2)


def test_values_of_any_shape(spark):
    rows = {
        '"  x "': ("x", "x"), "5": ("5", "5"), "true": ("true", "true"), "null": (None, None), "nope": (None, None), "[]": (None, None), '""': (None, None), "[null, 1, {}]": ("1; {}", "1"),
        '{"name": "", "title": "t"}': ("t", "t"), '{"a": 1}': ('{"a":1}', None), '[{"artist": {"name": "n"}, "title": "t"}, "z"]': ("t; z", "n; z"), '{"artist": {"title": " u "}, "mbid": "m"}': ('{"artist":{"title":" u "},"mbid":"m"}', "u"),
    }
    t = spark.createDataFrame([(k,) for k in rows] + [(None,)], "j string")
    got = {r.j: (r.text, r.names) for r in t.select("j", variants.text_of(variants.parse(F.col("j"))).alias("text"), variants.names(variants.parse(F.col("j"))).alias("names")).collect()}
    assert got == rows | {None: (None, None)}


# streams

START = datetime(2024, 1, 1)


def event_rows(seed):
    rng = random.Random(seed)
    kinds = ["click", "view", "view", "error"]
    return [(rng.randrange(5), i, START + timedelta(hours=i), rng.choice(kinds), None if rng.random() < 0.1 else float(rng.randrange(100))) for i in range(240)]


def expected_carry(rows):
    out, last = {}, {}
    for user, event, _, kind, value in sorted(rows, key=lambda r: (r[2], r[1])):
        if kind == "error":
            last[user] = None
        elif kind == "click" and value is not None:
            last[user] = value
        out[user, event] = last.get(user)
    return out


def write(spark, rows, folder):
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(folder)


def test_carried_state_over_a_restart(spark, tmp_path):
    """Files out of order within the watermark, a stop in between, and one row far too late."""
    rows, folder = event_rows(4), f"{tmp_path}/in"
    late = [r for r in rows if r[1] % 7 == 3]
    first = [r for r in rows if r not in late and r[1] < 120]
    schema = "user_id long, event_id long, ts timestamp, event_type string, value double"
    write(spark, first, folder)

    def run():
        stream = streaming.read_parquet_stream(spark, folder, spark.createDataFrame([], schema).schema)
        with state.state_store(spark):
            out = state.carried(stream, "user_id", "click", "error", "end", "10 days")
            streaming.run_available(out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/checkpoint")
        return {(r.key, r.event_id): r.carried for r in spark.read.schema("key long, event_id long, carried double").parquet(f"{tmp_path}/out").collect()}

    assert not run()  # all wait for the watermark
    write(spark, [*late, *[r for r in rows if r not in late and r[1] >= 120]], folder)
    write(spark, [(u, -1, START + timedelta(days=60), "end", None) for u in range(5)], folder)
    assert run() == expected_carry(rows)
    write(spark, [(0, 999, START, "click", 5.0), (0, 1000, START + timedelta(days=90), "click", 6.0)], folder)
    write(spark, [(0, -1, START + timedelta(days=120), "end", None)], folder)
    assert run() == expected_carry(rows) | {(0, 1000): 6.0}


def test_keys_share_a_state(spark, tmp_path):
    """Many users, one of them null: a batch fetches and stores a state for each group, not for each user."""
    rows = [(None if u == 7 else u, u * 100 + i, START + timedelta(hours=i), ("click", "error", "view", None)[(u + i) % 4], None if i % 5 == 2 else float(u + i)) for u in range(60) for i in range(12)]
    write(spark, rows, f"{tmp_path}/in")
    write(spark, [(u, -1, START + timedelta(days=60), "end", None) for u in range(60)], f"{tmp_path}/in")
    stream = streaming.read_parquet_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    with state.state_store(spark):
        out = state.carried(stream, "user_id", "click", "error", "end", groups=2)
        progress = streaming.run_available(out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/checkpoint")
    got = {(r.key, r.event_id): r.carried for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == expected_carry(rows)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) < 30


def test_observed_batches_and_an_abort(spark, tmp_path):
    rows = event_rows(5)
    for i in range(4):
        write(spark, rows[i * 60 : i * 60 + 60], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    seen = {"n": F.count(F.lit(1)), "most": F.max("event_id"), "total": F.sum("value")}
    run = lambda abort=None: streaming.run_observed(streaming.read_parquet_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/o", f"{tmp_path}/c", seen, abort)
    with pytest.raises(streaming.Aborted):
        run(lambda metrics: metrics.agg(F.sum("n")).first()[0] >= 120)
    assert spark.read.parquet(f"{tmp_path}/o/rows").count() == 120
    got = run().collect()  # goes on, and what was cut short is done again
    assert sorted(r.n for r in got) == [60] * 4 and max(r.most for r in got) == 239
    assert sum(r.total for r in got) == sum(r[4] or 0 for r in rows) and spark.read.parquet(f"{tmp_path}/o/rows").count() == 240
    n = streaming.write_counted(spark.range(100), f"{tmp_path}/w", most=F.max("id"))
    assert n == {"n": 100, "most": 99} and spark.read.parquet(f"{tmp_path}/w").count() == 100


def test_encoded_chunks_do_not_depend_on_tiles(spark):
    from meridia.operators.landmarks import Frames

    rows = [("a", i, [float((i + j) % 17) for j in range(50)]) for i in range(0, 1000, 50)]
    signal = spark.createDataFrame(rows, "clip_id string, at long, samples array<double>")
    one, two = ({(r.clip_id, r.segment_idx): tuple(r.embedding) for r in vector_index.encode_segments(signal, frames=Frames(64, 32, t)).collect()} for t in (1024, 5))
    assert one == two and len(one) == (1000 - 64) // 32 + 1
