"""Sinks of streams in processing order: slices, epochs and state against plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TICK = "symbol string, ts timestamp, price double"


def sunk(spark, at, schema, parts, sink, columns, route=lambda x: x):
    """Results of a sink over parts (lists of rows), a micro-batch each, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/part{k}")
        src = spark.readStream.schema(schema).parquet(f"{at}/in/*")  # a start for each part, from the same checkpoint
        route(src).writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return jobs.sink_results(spark, f"{at}/out", columns).withColumn("ts", F.unix_micros("ts")).collect()


def micros(t):
    return round((t - T0).total_seconds() * 1e6) + round(T0.timestamp() * 1e6)


def test_zscores_run_on_over_epochs(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [("ab"[int(rng.integers(2))], T0 + dt.timedelta(seconds=i), None if i % 37 == 5 else float(rng.normal(100, 1))) for i in range(300)]
    late = [(None, T0 + dt.timedelta(days=1, seconds=i), float(i)) for i in range(9)]
    parts = [[rows[i] for i in rng.permutation(140)], late, [rows[i] for i in 140 + rng.permutation(160)]]
    got = sunk(spark, tmp_path, TICK, parts, jobs.zscore_sink(f"{tmp_path}/out", 7), f"{TICK}, mean double, std double, z double")
    got = {(r["symbol"], r["ts"]): r for r in got}
    held, want = {}, {}
    for s, t, v in rows + late:
        held[s] = [*held.get(s, []), v][-7:]
        if len(held[s]) == 7:
            w = [x for x in held[s] if x is not None]
            want[s, micros(t)] = v, np.mean(w), np.std(w, ddof=1)
    assert set(got) == set(want) and len(want) == 300 - 12 + 3
    for k, (v, m, sd) in want.items():
        assert got[k]["price"] == v and got[k]["mean"] == pytest.approx(m) and got[k]["std"] == pytest.approx(sd)
        assert got[k]["z"] is None if v is None else got[k]["z"] == pytest.approx((v - m) / sd, abs=1e-9)


def test_pair_decisions_run_on_over_epochs(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [("pqr"[int(rng.integers(3))], T0 + dt.timedelta(seconds=i), float(rng.normal(100, 1))) for i in range(400)]
    parts = [[rows[i] for i in lo + rng.permutation(hi - lo)] for lo, hi in ((0, 9), (9, 200), (200, 400))]
    pairs = [("p", "q"), ("q", "r")]
    got = sunk(spark, tmp_path, TICK, parts, jobs.pair_sink(f"{tmp_path}/out", 8, 1.0, 0.3), "pair string, ts timestamp, z double, kappa double, position int", lambda x: jobs.route_to_pairs(x, pairs))
    got, n = {(r["pair"], r["ts"]): r for r in got}, 0
    for a, b in pairs:
        legs, position = {a: [], b: []}, 0
        for s, t, v in rows:
            if s not in legs:
                continue
            legs[s] = [*legs[s], v][-8:]
            if min(map(len, legs.values())) == 8:
                (m1, s1), (m2, s2) = ((np.mean(w), np.std(w, ddof=1)) for w in legs.values())
                z = (legs[a][-1] - m1) / s1 - s1 / s2 * (legs[b][-1] - m2) / s2
                position = (-1 if z >= 1 else 1 if z <= -1 else 0) if position == 0 else 0 if abs(z) <= 0.3 else position
                r, n = got[f"{a}|{b}", micros(t)], n + 1
                assert r["z"] == pytest.approx(z, abs=1e-9) and r["kappa"] == pytest.approx(s1 / s2) and r["position"] == position
    assert len(got) == n > 400


def test_an_idle_key_starts_anew(spark, tmp_path, monkeypatch):
    parts = [[("a", T0 + dt.timedelta(seconds=10 * k + i), float(i % 4)) for i in range(6)] for k in range(3)]
    times = iter([1e6, 1e6 + 50, 1e6 + 120])
    monkeypatch.setattr(jobs.time, "time", lambda: next(times))
    got = sunk(spark, tmp_path, TICK, parts, jobs.zscore_sink(f"{tmp_path}/out", 6, idle="1 minute"), f"{TICK}, mean double, std double, z double")
    assert len(got) == 1 + 6 + 1


@pytest.mark.parametrize("make", [lambda: jobs._ZScores(5, "price"), lambda: jobs._PairDecisions(5, 1.0, 0.3)])
def test_a_key_is_not_one_frame(make):
    rng, read = np.random.default_rng(10), 0

    def frames():
        nonlocal read
        for k in range(40):
            read += 1
            yield pd.DataFrame({"pair": "p", "tick": True, "leg": rng.integers(1, 3, 100), "price": rng.normal(0, 1, 100), "ts": k, "a": None, "b": None, "position": None, "seen": None})

    out = jobs._in_slices(make, "pair", ["pair", "ts", "z", "tick", "a", "b", "position", "seen"], 1)(frames())
    seen = [(len(x), read) for x in out]
    assert [r for _, r in seen] == [*range(1, 41), 40] and all(n <= 100 for n, _ in seen) and sum(n for n, _ in seen) > 3900


def test_moments_of_windows():
    v = np.array([1.0, 2.0, np.nan, 4.0, 4.0, 4.0, 4.0])
    mean, std = jobs.window_moments(v[:2], v[2:], 3)
    assert mean.tolist() == [1.5, 3.0, 4.0, 4.0, 4.0] and std[:2] == pytest.approx([math.sqrt(0.5), math.sqrt(2)]) and std[2:].tolist() == [0.0, 0.0, 0.0]
    mean, std = jobs.window_moments(v[:2], v[2:], 3, skip=False)
    assert np.isnan(mean[:3]).all() and mean[3:].tolist() == [4.0, 4.0] and std[3:].tolist() == [0.0, 0.0]
    assert np.isnan(jobs.window_moments(v[:1], v[1:2], 3)[0]).all()
    mean, std = jobs.window_moments(np.zeros(0), np.full(60, 29.27), 30)
    assert set(mean[29:]) == {29.27} and set(std[29:]) == {0.0}
