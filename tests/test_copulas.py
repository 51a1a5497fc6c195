"""Rank correlation and fitted elliptical copulas against brute force and simulated parameters."""

import math

import numpy as np
import pytest

from tickloom.functions import stats
from tickloom.operators import copulas


def brute_tau(x, y):
    s = a = b = 0
    for i in range(len(x)):
        for j in range(i):
            u, v = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, a, b = s + u * v, a + abs(u), b + abs(v)
    return s / math.sqrt(a * b) if a and b else math.nan


@pytest.mark.parametrize(("n", "values"), [(2, 9), (50, 1000), (300, 8), (300, 10**6), (131, 3)])
def test_tau_equals_all_pairs(n, values):
    rng = np.random.default_rng(n + values)
    x, y = rng.integers(0, values, n).astype(float), rng.integers(0, values, n).astype(float)
    y[: n // 2] += x[: n // 2]
    assert copulas.kendall_tau(x, y) == pytest.approx(brute_tau(x, y), nan_ok=True)


def test_tau_of_orders_and_constants():
    x = np.arange(200.0)
    assert copulas.kendall_tau(x, x) == 1 and copulas.kendall_tau(x, -x) == -1
    assert math.isnan(copulas.kendall_tau(x, x * 0)) and math.isnan(copulas.kendall_tau(x[:1], x[:1]))


def t_sample(rng, n, rho, df):
    z = rng.standard_normal((n, 2)) @ np.linalg.cholesky([[1, rho], [rho, 1]]).T
    return z / np.sqrt(rng.chisquare(df, n) / df)[:, None]


@pytest.mark.parametrize(("rho", "df"), [(0.6, 4.0), (-0.3, 8.0)])
def test_simulated_parameters_are_recovered(spark, rho, df):
    x = t_sample(np.random.default_rng(7), 6000, rho, df)
    u = stats.t_cdf(x, df)
    rows = [("a", "b", float(p), float(q)) for p, q in u] + [("a", "c", 0.5, float(q)) for q in u[:50, 1]] + [("b", "c", None, 0.1), ("b", "c", 0.2, 0.3)]
    got = {(r["sym1"], r["sym2"]): r for r in copulas.fit_elliptical(spark.createDataFrame(rows, "sym1 string, sym2 string, u1 double, u2 double")).collect()}
    r = got["a", "b"]
    assert r["rho"] == pytest.approx(rho, abs=0.03) and r["df"] == pytest.approx(df, rel=0.3) and r["n"] == 6000
    assert got["a", "c"]["tau"] is None and got["b", "c"]["rho"] is None and got["b", "c"]["n"] == 1


def test_conditional_t_by_column_equals_one_set_of_parameters(spark):
    rng = np.random.default_rng(8)
    rows = [(float(u), float(v), r, d) for u, v in rng.random((40, 2)) for r, d in ((0.3, 5.0), (-0.5, 9.0))] + [(None, 0.5, 0.3, 5.0)]
    x = spark.createDataFrame(rows, "u double, v double, rho double, df double").coalesce(1)
    got = [r["h"] for r in x.select(copulas.t_conditional("u", "v", "rho", "df").alias("h")).collect()]
    for (u, v, r, d), h in zip(rows, got, strict=True):
        assert h is None if u is None else h == pytest.approx(float(stats.conditional_t(np.array([u]), np.array([v]), r, d)[0]))


def test_likelihood_falls_away_from_the_simulated_df():
    u = stats.t_cdf(t_sample(np.random.default_rng(9), 4000, 0.5, 4.0), 4.0)
    best = copulas.t_copula_loglik(u[:, 0], u[:, 1], 0.5, 4.0)
    assert best > copulas.t_copula_loglik(u[:, 0], u[:, 1], 0.5, 1.5) and best > copulas.t_copula_loglik(u[:, 0], u[:, 1], 0.5, 50.0)
