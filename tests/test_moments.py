"""Moments and correlations where values don't vary, are exact or are many."""

import datetime as dt
import math
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tickloom.operators import gram, indicators, portfolio
from tickloom.plans import trade_queries

T0 = dt.datetime(2024, 1, 1)


def test_force_bears_a_constant_volume(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), float(i * 37 % 11), 2.0 if i < 15 else float(i)) for i in range(20)]
    got = {r["ts"]: r for r in indicators.force(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volume double")).collect()}
    of = [got[r[1]]["pv_corr"] for r in rows]
    assert of[:12] == [None] * 12 and all(math.isnan(v) for v in of[12:15]) and all(-1 <= v <= 1 for v in of[15:])
    assert got[rows[13][1]]["force"] is not None


def users(n=150, days=40, seed=5):
    """Values of n symbols, a tenth of them missing, and a row without a symbol."""
    rng = np.random.default_rng(seed)
    v = np.where(rng.random((n, days)) < 0.1, np.nan, rng.normal(0, 1, (n, days)))
    rows = [(f"u{i:03d}", T0 + dt.timedelta(days=d), float(v[i, d])) for i in range(n) for d in range(days) if not math.isnan(v[i, d])]
    return pd.DataFrame(v.T, columns=[f"u{i:03d}" for i in range(n)]), [*rows, (None, T0, 1.0)]


def test_correlations_of_several_strips_without_a_shuffle_of_pairs(spark):
    wide, rows = users()
    x = gram.correlations(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double"))
    plan = x._jdf.queryExecution().executedPlan().toString()
    made = plan.index("MapIn")  # pairs are made here; what stands before comes after it
    assert not any(word in plan[:made] for word in ("Exchange", "Join", "Aggregate", "Sort"))
    want, got = wide.corr(), {(r["sym1"], r["sym2"]): r for r in x.collect()}
    assert len(got) == 150 * 149 // 2
    for (a, b), r in list(got.items())[::97]:
        assert a < b and r["corr"] == pytest.approx(want.loc[a, b], abs=1e-12) and r["n"] == (wide[a].notna() & wide[b].notna()).sum()


def strips(meetings=60, tiles=1, blocks=6, times=8):
    rng, out = np.random.default_rng(6), []
    for b in range(1, meetings + 1):
        both = [(s, s * tiles + t) for s in (0, b) for t in range(tiles)]
        out += [{"a": 0, "b": b, "strip": s, "tile": t, "block": None, "times": None, "m": None, "names": [f"u{64 * t + i:05d}" for i in range(64)]} for s, t in both]
        for k in range(blocks):
            at = np.arange(k * times, (k + 1) * times)
            out += [{"a": 0, "b": b, "strip": s, "tile": t, "block": k, "times": at.tobytes(), "m": rng.normal(0, 1, (64, times)).tobytes(), "names": None} for s, t in both]
    return pa.RecordBatch.from_pylist(out)


def test_sums_of_one_meeting_are_held_at_a_time(monkeypatch):
    batch = strips()
    tracemalloc.start()
    n = sum(b.num_rows for b in gram._products(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60 * 64 * 64 and peak < 4 << 20  # six matrices of one meeting are 0.2 MB, of all 12 MB
    batch = strips(2, 5)
    whole = pa.Table.from_batches(gram._products(iter([batch]))).to_pandas()
    monkeypatch.setattr(gram, "HELD", 1)  # every block is added to the sums before the next
    folded = pa.Table.from_batches(gram._products(iter([batch.slice(0, 40), batch.slice(40)]))).to_pandas()
    pd.testing.assert_frame_equal(whole, folded)
    assert len(whole) == 2 * 320 * 320 and (whole["n"] == 48).all()


def test_asset_means_at_ties_of_their_last_digit(spark, tmp_path):
    rng, kinds, rows, want = np.random.default_rng(7), ["click", "error", "purchase", "view"], [], []
    for k in kinds:
        cents = rng.integers(0, 20000, 720)
        cents[0] += 1 - cents.sum() % 2  # so that 252 / 720 of the sum ends in 5 at the seventh place
        units = int(cents.sum() - 720 * 5000) * 35
        want.append((abs(units) + 5) // 10 * (1 if units > 0 else -1) / 1e6)
        rows += [(T0 + dt.timedelta(hours=h), k, float(c) / 100) for h, c in enumerate(cents)]
    x = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double")
    x.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = trade_queries.t19_asset_moments(spark, str(tmp_path)).collect()[0]
    assert got["symbols"] == kinds and got["mean"] == pytest.approx(want, abs=1e-9)


def test_asset_means_of_what_decimals_do_not_hold(spark):
    rows = [("a", T0, 1e12), ("a", T0 + dt.timedelta(days=1), 3e12), ("b", T0, 0.25), ("b", T0 + dt.timedelta(days=1), None), ("c", T0, None)]
    x = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double")
    assert portfolio.asset_moments(x, 1.0).collect()[0]["mean"] == [2e12, 0.25, None]
    assert portfolio.asset_moments(x, 0.125).collect()[0]["mean"] == [2.5e11, 0.03125, None]
