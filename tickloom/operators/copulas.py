"""Gaussian and t copulas fitted per pair: Kendall's tau by counting inversions, degrees of freedom by profile likelihood."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import stats

PAIR = ("sym1", "sym2")
#: Degrees of freedom that are tried first; the best one's neighbourhood is then searched.
GRID = (1.5, 2.0, 3.0, 4.0, 6.0, 9.0, 14.0, 22.0, 35.0, 60.0)


def inversions(a: np.ndarray) -> tuple[int, np.ndarray]:
    """How many pairs i < j have a[i] > a[j], by merging halves; and a, sorted."""
    n = len(a)
    if n <= 64:
        return int(np.triu(a[:, None] > a[None, :], 1).sum()), np.sort(a)
    (x, left), (y, right) = inversions(a[: n // 2]), inversions(a[n // 2 :])
    across = len(left) * len(right) - int(np.searchsorted(left, right, "right").sum())
    return x + y + across, np.sort(np.concatenate([left, right]), kind="stable")


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in n log n steps: ties in one of the two don't count as a pair of it; NaN if one doesn't vary."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    pairs = lambda *v: int((c := np.unique(np.stack(v, 1), axis=0, return_counts=True)[1]) @ (c - 1)) // 2
    total, tx, ty, both = n * (n - 1) // 2, pairs(x), pairs(y), pairs(x, y)
    if n < 2 or tx == total or ty == total:
        return math.nan
    against, _ = inversions(y)  # rows of equal x are in the order of y, so they are none
    return (total - tx - ty + both - 2 * against) / math.sqrt((total - tx) * (total - ty))


def t_copula_loglik(u: np.ndarray, v: np.ndarray, rho: float, df: float) -> float:
    """The log-likelihood of a t copula."""
    x, y = stats.t_quantile(u, df), stats.t_quantile(v, df)
    r = 1 - rho * rho
    each = math.lgamma((df + 2) / 2) + math.lgamma(df / 2) - 2 * math.lgamma((df + 1) / 2) - 0.5 * math.log(r)
    rest = (df + 1) / 2 * (np.log1p(x * x / df) + np.log1p(y * y / df)) - (df + 2) / 2 * np.log1p((x * x + y * y - 2 * rho * x * y) / (df * r))
    return float(len(u) * each + rest.sum())


def fit_df(u: np.ndarray, v: np.ndarray, rho: float, steps: int = 12) -> float:
    """The degrees of freedom of highest likelihood given rho: the best of GRID, then golden sections between its neighbours, on the log scale."""
    u, v = (np.clip(a, 1e-6, 1 - 1e-6) for a in (u, v))
    score = lambda z: t_copula_loglik(u, v, rho, math.exp(z))
    grid = np.log(GRID)
    best = int(np.argmax([score(z) for z in grid]))
    lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = score(a), score(b)
    for _ in range(steps):
        if fa >= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = score(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = score(b)
    return math.exp((lo + hi) / 2)


def fit_elliptical(uniform: DataFrame, at_least: int = 20) -> DataFrame:
    """sym1, sym2, tau, rho, df, n of each pair (u1, u2): rho = sin(pi tau / 2) for both copulas, df of the t copula.

    Null for fewer than `at_least` rows, or where one leg doesn't vary. A pair's history is one group of two columns.
    """

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna()
        u, v = p["u1"].to_numpy(float), p["u2"].to_numpy(float)
        tau = kendall_tau(u, v) if len(u) >= at_least else math.nan
        if math.isnan(tau):
            row = [*key, None, None, None, len(u)]
        else:
            rho = min(1 - 1e-6, max(-1 + 1e-6, math.sin(math.pi * tau / 2)))
            row = [*key, tau, rho, fit_df(u, v, rho), len(u)]
        return pd.DataFrame([row], columns=["sym1", "sym2", "tau", "rho", "df", "n"])

    return uniform.select(*PAIR, "u1", "u2").groupBy(*PAIR).applyInPandas(run, "sym1 string, sym2 string, tau double, rho double, df double, n long")


@F.pandas_udf(DoubleType())
def t_conditional(u: pd.Series, v: pd.Series, rho: pd.Series, df: pd.Series) -> pd.Series:
    """P(U <= u | v) under a t copula, parameters row by row; a batch holds few sets of them."""
    x, p = np.stack([u.to_numpy(float), v.to_numpy(float)], 1), np.stack([rho.to_numpy(float), df.to_numpy(float)], 1)
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(np.isfinite(x).all(1) & np.isfinite(p).all(1))
    kinds, of = np.unique(p[at], axis=0, return_inverse=True)
    for k, (r, d) in enumerate(kinds):
        rows = at[of.reshape(-1) == k]
        out[rows] = stats.conditional_t(x[rows, 0], x[rows, 1], r, d)
    return pd.Series(out).astype(object).where(np.isfinite(out), None).astype(float)


def fitted_mispricing(uniform: DataFrame) -> DataFrame:
    """(sym1, sym2, ts, u1, u2) with h1 and h2 of each pair's fitted Tawn copula, gauss and t of its fitted elliptical ones.

    The fits are a row a pair and are joined back on the pair.
    """
    from .pairs import fit_copulas, gaussian_conditional, mispricing

    x = uniform.join(fit_copulas(uniform).select(*PAIR, "theta", "psi"), list(PAIR)).join(fit_elliptical(uniform).select(*PAIR, "rho", "df"), list(PAIR))
    h1, h2 = mispricing(F.col("u1"), F.col("u2"), F.col("theta"), F.col("psi"))
    return x.select(*PAIR, "ts", "u1", "u2", h1.alias("h1"), h2.alias("h2"), gaussian_conditional("u1", "u2", "rho").alias("gauss"), t_conditional("u1", "u2", "rho", "df").alias("t"))
