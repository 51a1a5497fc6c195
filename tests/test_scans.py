"""Two-pass prefix sums, Gram tiles and affine scans against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import align, gram, pairs, prefix, recursive, scan

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(5):
        c = 100 + rng.normal(0, 1, 400).cumsum()
        for i in range(400 if k else 37):  # one short history
            if k < 3 or rng.random() < 0.8:  # two with gaps
                rows.append((f"s{k}", T0 + dt.timedelta(hours=i), float(c[i] + 1), float(c[i] - 1), float(c[i])))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, high double, low double, close double").repartition(3)


def many_ranges(spark, n):
    """More ranges than rows of a symbol need, so that pieces end inside every warm-up."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))


@pytest.fixture
def ranges(spark):
    many_ranges(spark, 40)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_numbers_and_running_sums(spark, ranges):
    v = np.random.default_rng(0).permutation(300)
    x = spark.createDataFrame([(int(k), float(k % 7)) for k in v], "ts long, v double")
    got = sorted(tuple(r) for r in prefix.numbered(x, ["ts"], "i", "n").collect())
    assert got == [(k, float(k % 7), k, 300) for k in range(300)]
    got = {r["ts"]: (r["s"], r["p"]) for r in prefix.running(x, ["ts"], {"s": "v"}, {"p": "v"}).collect()}
    assert got == {k: (float(sum(i % 7 for i in range(k + 1))), float((k - 1) % 7) if k else None) for k in range(300)}
    assert prefix.running(x.limit(0), ["ts"], {"s": "v"}).collect() == [] and prefix.numbered(x.limit(0), ["ts"]).collect() == []


def test_no_task_gets_all_times(spark, ranges):
    x = prefix.running(spark.range(1000).withColumnRenamed("id", "ts"), ["ts"], {"s": "ts"})
    per = x.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("s")).collect()
    assert len(per) > 10 and max(r["n"] for r in per) < 300


def test_diversification_equals_a_loop(spark, ranges):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (150, 3)) @ rng.normal(0, 1, (3, 3)) + 1000
    rows = [(T0 + dt.timedelta(hours=i), *(None if i == 70 and j == 1 else float(x) for j, x in enumerate(r))) for i, r in enumerate(v)]
    x = spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, c double")
    got = {r["ts"]: r["diversification"] for r in recursive.diversification(x, ["a", "b", "c"], 6).collect()}
    for i in range(150):
        w = np.array([r for j, r in enumerate(v[: i + 1]) if i - j < 6 and j != 70])
        if len(w) < 2:
            assert got[rows[i][0]] is None
        else:
            lam = np.linalg.eigvalsh(np.cov(w.T))
            assert got[rows[i][0]] == pytest.approx(1 - lam[-1] / lam.sum(), abs=1e-6)


def test_scan_equals_the_sequential_fold(spark, bars, ranges):
    got = scan.scanned_columns(bars).orderBy("symbol", "ts").toPandas()
    want = recursive.recursive_columns(bars).orderBy("symbol", "ts").toPandas()
    assert len(got) == len(want)
    for c in scan.FIELDS:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-12, err_msg=c)
    grid = scan.ema_grid(bars).orderBy("symbol", "ts").toPandas()
    want = recursive.ema_grid(bars).orderBy("symbol", "ts").toPandas()
    for c in ("ema_rel_20", "ema_delta_40_80"):
        np.testing.assert_allclose(grid[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, err_msg=c)
    assert scan.scanned_columns(bars.limit(0)).collect() == []


def test_a_history_is_many_pieces(spark, bars, ranges):
    x = prefix.dealt(bars, ["symbol", "ts"])
    p = prefix.pieces(x, "symbol").where("symbol = 's1'").orderBy("piece").collect()
    assert len(p) > 5 and [r["before"] for r in p] == [sum(q["n"] for q in p[:i]) for i in range(len(p))]


def test_composed_steps_equal_replayed_ones():
    rng = np.random.default_rng(2)
    steps = rng.normal(0, 1, 50), rng.normal(0, 1, 50)
    a, b = scan.compose(steps)
    assert scan.replay(steps, 3.0)[-1] == pytest.approx(a * 3.0 + b)
    assert scan.compose((np.zeros(0), np.zeros(0))) == (1.0, 0.0)


def test_gram_moments_equal_pairwise_loops(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = (np.where(rng.random((4, 60)) < 0.3, np.nan, rng.normal(0, 1, (4, 60))) for _ in range(2))
    got = gram.moments(a, b)
    for i in range(4):
        for j in range(4):
            ok = ~np.isnan(a[i]) & ~np.isnan(b[j])
            x, y = a[i][ok], b[j][ok]
            np.testing.assert_allclose([g[i, j] for g in got], [ok.sum(), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()])


@pytest.mark.parametrize("tile", [2, 64])
def test_gram_tiles_equal_own_returns_with_gaps(spark, bars, monkeypatch, tile):
    from tickloom.functions import rolling as R

    monkeypatch.setattr(gram, "TILE", tile)  # the workers' copies of the functions carry it as well
    monkeypatch.setattr(gram, "_pack", _with_tile(gram._pack, tile))
    monkeypatch.setattr(gram, "_products", _with_tile(gram._products, tile))
    x = bars.withColumn("ret", R.ret())
    p = x.toPandas().pivot(index="ts", columns="symbol", values="ret")
    got = {(r["sym1"], r["sym2"]): r for r in gram.correlations(x, unit="day").collect()}
    cov = {(r["sym1"], r["sym2"]): r["cov"] for r in gram.covariances(x, unit="month").collect()}
    assert len(got) == 10 and len(cov) == 15
    for (a, b), r in got.items():
        assert r["corr"] == pytest.approx(p[a].corr(p[b]), abs=1e-12) and r["n"] == int((p[a].notna() & p[b].notna()).sum())
        assert cov[a, b] == pytest.approx(p[a].cov(p[b]) * 252, rel=1e-9)
    assert gram.correlations(x.limit(0)).collect() == []


def _with_tile(f, tile):
    """f with TILE as it is here, also in workers, which import the module anew."""
    import types

    g = types.FunctionType(f.__code__, {**f.__globals__, "TILE": tile}, f.__name__)
    g.__module__ = "__main__"
    return g


def test_gram_equals_the_join_on_a_common_calendar(spark, bars):
    from tickloom.functions import rolling as R
    from tickloom.operators import metrics

    some = align.common_calendar(bars.where("symbol in ('s1', 's2')"))
    want = metrics.pair_correlation(pairs.pair_returns(align.pair_bars(some))).collect()
    got = gram.correlations(some.withColumn("ret", R.ret())).collect()
    assert len(got) == len(want) == 1 and got[0]["n"] == want[0]["n"] and got[0]["corr"] == pytest.approx(want[0]["corr"], abs=1e-12)
    assert gram.candidates(some.withColumn("ret", R.ret()), -1.0).count() == 1 and gram.candidates(some.withColumn("ret", R.ret()), 1.1).count() == 0
