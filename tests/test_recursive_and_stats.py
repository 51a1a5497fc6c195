import math

import numpy as np
import pandas as pd
import pytest

from tickloom.functions import stats
from tickloom.operators import evaluate, pairs, recursive


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(1)
    c = 100 + rng.normal(0, 1, 300).cumsum()
    return c + rng.uniform(0, 1, 300), c - rng.uniform(0, 1, 300), c


def test_ema_matches_pandas(walk):
    c = walk[2]
    assert np.allclose(recursive.ema(c, 12), pd.Series(c).ewm(span=12, adjust=False).mean())
    assert np.allclose(recursive.ewm_adjusted(c, 0.3), pd.Series(c).ewm(alpha=0.3).mean())


def test_wilder_and_rsi(walk):
    c = walk[2]
    d = np.diff(c)
    g, l = d[:14].clip(0).mean(), (-d[:14]).clip(0).mean()
    want = [100 - 100 / (1 + g / l)]
    for x in d[14:]:
        g, l = (g * 13 + max(x, 0)) / 14, (l * 13 + max(-x, 0)) / 14
        want.append(100 - 100 / (1 + g / l))
    got = recursive.rsi_wilder(c)
    assert np.isnan(got[:14]).all() and np.allclose(got[14:], want)


def test_bounds_and_short_inputs(walk):
    h, l, c = walk
    p, m, adx, adxr = recursive.dmi(h, l, c)
    for x in (p, m, adx, adxr):
        v = x[~np.isnan(x)]
        assert len(v) and (v >= 0).all() and (v <= 100 + 1e-9).all()
    s = recursive.psar(h, l)
    assert not np.isnan(s[1:]).any()
    one = recursive.compute(h[:1], l[:1], c[:1])
    assert set(one) == set(recursive.FIELDS)
    flat = recursive.compute(np.ones(50), np.ones(50), np.ones(50))
    assert np.allclose(flat["macd"], 0) and np.isnan(flat["rsi"][:14]).all()


def test_garch(walk):
    r = np.diff(walk[2]) / 100
    v = recursive.garch(r, 1e-6, 0.1, 0.8, 20)
    assert np.isnan(v[:19]).all() and math.isclose(v[20], 1e-6 + 0.1 * r[19] ** 2 + 0.8 * v[19])


def test_unit_root_statistics():
    rng = np.random.default_rng(2)
    e = rng.normal(size=500)
    ar = np.zeros(500)
    for i in range(1, 500):
        ar[i] = 0.5 * ar[i - 1] + e[i]
    assert stats.adf(ar)[1] < 0.01 < 0.1 < stats.adf(e.cumsum())[1]
    x = e.cumsum() + 50
    t, p, b = stats.engle_granger(2 * x + ar + 3, x)
    assert p < 0.01 and abs(b - 2) < 0.1
    # fixed values: 5 % points of the published tables
    assert abs(stats.p_value(-2.86, 1) - 0.05) < 0.003 and abs(stats.p_value(-3.34, 2) - 0.05) < 0.003


def test_distributions():
    assert math.isclose(float(stats.t_cdf(np.array([2.228139]), 10)[0]), 0.975, abs_tol=1e-6)
    assert math.isclose(float(stats.normal_quantile(0.975)), 1.959964, abs_tol=1e-5)
    assert math.isclose(float(stats.t_quantile(np.array([0.975]), 10)[0]), 2.228139, abs_tol=1e-5)
    rng = np.random.default_rng(3)
    df, loc, scale = stats.fit_t(rng.standard_t(4, 4000) * 2 + 1)
    assert 3 < df < 5.5 and abs(loc - 1) < 0.15 and abs(scale - 2) < 0.2
    assert all(math.isnan(v) for v in stats.fit_t(np.ones(10)))


def test_copulas():
    rng = np.random.default_rng(4)
    u, v = rng.uniform(size=200), rng.uniform(size=200)
    u[10:15] = u[3]
    want = [((u <= a) & (v <= b)).mean() for a, b in zip(u, v, strict=True)]
    assert np.allclose(stats.empirical_copula(u, v), want)
    assert np.allclose(stats.tawn_cdf(u, v, 1.0, 0.5), u * v)
    h1, h2 = stats.tawn_h(u, v, 3.0, 0.7)
    assert ((h1 >= 0) & (h1 <= 1) & (h2 >= 0) & (h2 <= 1)).all()
    assert np.allclose(stats.conditional_gaussian(u, v, 0.0), u, atol=1e-9)


def test_hidden_states():
    rng = np.random.default_rng(5)
    z = np.repeat([0, 1, 0, 1], 100)
    path, mu, _ = stats.hmm(rng.normal(np.where(z, 3, -3), 1), 2)
    assert (path == z).mean() > 0.98 and mu[0] < mu[1]


def test_folds():
    z = np.array([0, 2.5, 1, -0.1, -2.5, -1, 0.2, 2.2])
    p = np.full(8, 0.01)
    assert pairs.fold(z, p, 2, 0.05, 0.1).tolist() == [0, -1, -1, 0, 1, 1, 0, -1]
    o = np.array([10, 10, 10, 12.0])
    q, v = evaluate.bracket_fold(o, np.array([10, 10.5, 12, 12.0]), np.array([10, 9.9, 9.9, 12]), o, np.array([1, 0, 0, 0.0]), 0.1, 0.1)
    assert q.tolist() == [0, 1, 0, 0] and math.isclose(v[-1], 1.0)
    assert evaluate.hysteresis(np.array([0.2, 0.4, 0.2, 0.05, -0.5, np.nan])).tolist() == [0, 1, 1, 0, -1, -1]


def test_frontier_weights(spark):
    from tickloom.operators.portfolio import best_rows, frontier

    f = frontier(spark, [0.1, 0.2], [[0.04, 0.01], [0.01, 0.09]], 200)
    rows = f.collect()
    assert len(rows) == 200 and all(abs(sum(r["weights"]) - 1) < 1e-9 and min(r["weights"]) >= 0 for r in rows)
    assert {r["pick"] for r in best_rows(f).collect()} == {"max_sharpe", "min_vol"}
