import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions import stats
from tickloom.operators import candles, features, recursive, scores

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, rows, symbol="a"):
    start = pd.Timestamp("2024-01-01")
    return spark.createDataFrame([(symbol, (start + pd.Timedelta(hours=i)).to_pydatetime(), *map(float, r)) for i, r in enumerate(rows)], SCHEMA)


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(0, 1, n))
    o = np.concatenate([[100], c[:-1]]) + rng.normal(0, 0.3, n)
    h, l = np.maximum(o, c) + rng.uniform(0, 1, n), np.minimum(o, c) - rng.uniform(0, 1, n)
    return np.stack([o, h, l, c, rng.integers(1, 50, n)], 1)


def last(x):
    return x.orderBy("ts").collect()[-1]


def test_shapes_of_candles(spark):
    flat = [(10, 10.6, 9.9, 10.5, 5)] * 25
    got = last(candles.candlestick(bars(spark, [*flat, (10, 10.21, 9.0, 10.2, 5)])))
    assert got["hammer"] == 2.0  # bodies shrink, so the trend of the rule is down
    assert last(candles.single(bars(spark, [*flat, *[(10, 12.2, 9.9, 12, 5)] * 4, (10, 12.05, 5.0, 12, 5)])))["hammer"] < 0  # a hanging man
    got = last(candles.double(bars(spark, [*flat, (10.2, 10.3, 9.9, 10.0, 5), (9.9, 10.7, 9.8, 10.6, 5)])))
    assert got["engulfing"] == 2.0 and got["harami"] == 0
    assert last(candles.double(bars(spark, [*flat, (10, 10.6, 9.0, 10.4, 5)])))["tweezer"] == -1.0
    assert last(candles.double(bars(spark, [*flat, (10, 10.9, 9.9, 10.4, 5)])))["tweezer"] == 1.0
    up = [(10, 10.1, 8.9, 9.0, 5), (9.2, 9.8, 9.1, 9.7, 5), (9.6, 10.2, 9.5, 10.1, 5)]
    got = last(candles.triple(bars(spark, [*flat, *up])))
    assert math.isclose(got["inside"], 0.5) and got["outside"] == 0
    got = last(candles.triple(bars(spark, [*flat, (10, 10.1, 9.4, 9.5, 5), (9.4, 10.2, 9.3, 10.1, 5), (10.1, 10.7, 10, 10.6, 5)])))
    assert math.isclose(got["outside"], 1.0)


def test_levels_against_counting(spark):
    rows = walk(120)
    lo, hi = rows[:, 2].min(), rows[:, 1].max()
    step = (hi - lo) / 50
    want = []
    for b in range(50):
        hit = (rows[:, 1] > lo + b * step) & (rows[:, 2] < lo + (b + 1) * step)
        if hit.sum() >= 3:
            want.append((-hit.sum() * np.exp(-np.flatnonzero(hit) / 100).sum(), b, int(hit.sum())))
    got = scores.levels(bars(spark, rows), bins=50).orderBy("rank").collect()
    assert [(r["bin"], r["touches"]) for r in got] == [(b, n) for _, b, n in sorted(want)[:5]]
    assert np.allclose([r["strength"] for r in got], [-s for s, _, _ in sorted(want)[:5]])
    assert scores.levels(bars(spark, [])).count() == 0


def test_standard_features_against_pandas(spark):
    rows = walk(80, 3)
    got = features.standard_features(bars(spark, rows)).orderBy("ts").toPandas()
    p = pd.Series(rows[:, 3])
    r = p.pct_change()
    line = p.ewm(span=12, adjust=False).mean() - p.ewm(span=26, adjust=False).mean()
    gain, loss = r.clip(lower=0).rolling(14).mean(), (-r).clip(lower=0).rolling(14).mean()
    want = {
        "return": r, "volatility": r.rolling(14).std(), "momentum": r.rolling(14).mean(), "price_to_sma": p / p.rolling(14).mean(), "price_std": p.rolling(14).std(), "rsi": 100 - 100 / (1 + gain / loss), "macd": line,
        "macd_signal": line.ewm(span=9, adjust=False).mean(), "bb_position": (p - p.rolling(20).mean() + 2 * p.rolling(20).std()) / (4 * p.rolling(20).std()), "skewness": r.rolling(14).skew(), "kurtosis": r.rolling(14).kurt(),
    }
    want = pd.DataFrame(want).ffill().dropna()
    assert list(got.columns) == ["symbol", "ts", *features.STANDARD] and len(got) == len(want) == 61
    for c in features.STANDARD:
        assert np.allclose(got[c], want[c], atol=1e-8), c


def test_feature_pipeline_follows_its_configuration(spark):
    b = bars(spark, walk(70, 4))
    x = features.feature_pipeline(b)
    assert x.count() == 70 - 49 and "ema_20" in x.columns and "volatility_10" in x.columns
    few = features.feature_pipeline(b, [features.Build("mean", (5,))])
    assert few.columns == [*b.columns, "sma_5"] and few.count() == 66
    assert features.feature_pipeline(b.limit(12)).count() == 0
    grid = last(recursive.ema_grid(b, 5, 15, 5))
    c = np.array([r["close"] for r in b.orderBy("ts").collect()])
    e5, e10 = recursive.ema(c, 5)[-1] / c[-1], recursive.ema(c, 10)[-1] / c[-1]
    assert math.isclose(grid["ema_rel_5"], e5) and math.isclose(grid["ema_delta_5_10"], e5 - e10) and "ema_rel_15" not in grid.asDict()


def test_ranks_so_far_and_t_functions():
    x = np.array([2.0, np.nan, 1.0, 2.0, 3.0])
    assert np.allclose(recursive.rank_so_far(x), [1, np.nan, 0.5, 1, 1], equal_nan=True)
    assert np.allclose(stats.t_cdf(np.array([0.0, 1.0, -2.0, np.nan]), 3), [0.5, 0.8044988905, 0.0696629843, np.nan], atol=1e-9, equal_nan=True)
    u = np.array([0.2, 0.5, 0.9])
    assert np.allclose(stats.conditional_t(u, np.array([0.5, 0.5, 0.5]), 0.0, 5.0)[1], 0.5)
    rng = np.random.default_rng(2)  # against simulated draws near a given v
    w = np.sqrt(5 / rng.chisquare(5, 400_000))
    z = rng.normal(size=(2, 400_000))
    a, b = z[0] * w, (0.3 * z[0] + math.sqrt(1 - 0.09) * z[1]) * w
    v = 0.8
    near = np.abs(stats.t_cdf(b, 5.0) - v) < 0.01
    want = np.mean(stats.t_cdf(a[near], 5.0) <= 0.6)
    assert abs(float(stats.conditional_t(np.array([0.6]), np.array([v]), 0.3, 5.0)[0]) - want) < 0.02


def test_volume_score_and_classes(spark):
    x = bars(spark, walk(60, 5))
    r = last(scores.volume_score(x))
    assert all(r[c] is not None for c in scores.VOLUME)
    want = max(-1.0, min(1.0, sum(w * r[c] for c, w in scores.VOLUME.items())))
    assert math.isclose(r["volume_score"], want)
    y = x.withColumn("rsi", F.lit(65.0)).withColumn("adx", F.lit(41.0))
    assert last(scores.classes(y))["rsi_zone"] == 1 and last(y.withColumn("k", scores.adx_class()))["k"] == 2
