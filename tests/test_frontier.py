"""Moments of a stated set of assets as one row, and portfolios from it."""

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import portfolio

T0 = dt.datetime(2024, 1, 1)


def test_portfolios_from_one_row_equal_those_from_literals(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0.001, 0.02, (40, 3)) @ rng.normal(0, 1, (3, 3))
    rows = [(s, T0 + dt.timedelta(days=i), float(r[i, k])) for k, s in enumerate("bac") for i in range(40)]
    x = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double")
    m = portfolio.asset_moments(x, 252.0)
    one = m.collect()
    assert len(one) == 1 and one[0]["symbols"] == ["a", "b", "c"]
    at = [1, 0, 2]
    mean, cov = r[:, at].mean(0) * 252, np.cov(r[:, at].T) * 252
    assert one[0]["mean"] == pytest.approx(mean.tolist()) and one[0]["cov"] == pytest.approx(cov.ravel().tolist())
    got = {p["id"]: p for p in portfolio.frontier_of(m, 2500, block=300).collect()}
    want = {p["id"]: p for p in portfolio.frontier(spark, mean.tolist(), cov.tolist(), 2500).collect()}
    assert sorted(got) == sorted(want) == list(range(2500))
    for i in range(0, 2500, 97):
        for c in ("ret", "vol", "sharpe"):
            assert got[i][c] == pytest.approx(want[i][c])
        assert got[i]["weights"] == pytest.approx(want[i]["weights"]) and sum(got[i]["weights"]) == pytest.approx(1)
    assert portfolio.frontier_of(portfolio.asset_moments(x.limit(0)), 100).collect() == []
