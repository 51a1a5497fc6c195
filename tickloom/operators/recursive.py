"""Recursive smoothing and state machines, all in one pass per symbol.

SQL has no recursion over rows. The helpers are numpy over one symbol's ordered bars; `recursive_columns` computes all of
them in one grouped pass, so bars are shuffled by symbol once.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import numbered


def ema(x: np.ndarray, n: float | None = None, alpha: float | None = None, seed: str = "first") -> np.ndarray:
    """e = a x + (1 - a) e. seed "first": starts at the first value; "sma": at the mean of the first n, null before."""
    a = alpha if alpha is not None else 2 / (n + 1)
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x))
    if not len(ok):
        return out
    at = ok[0]
    if seed == "sma":
        n = int(n)
        if len(x) - at < n:
            return out
        e = x[at : at + n].mean()
        at += n - 1
    else:
        e = x[at]
    out[at] = e
    for i in range(at + 1, len(x)):
        if not np.isnan(x[i]):
            e = a * x[i] + (1 - a) * e
        out[i] = e
    return out


def ewm_adjusted(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponentially weighted mean with weights (1 - alpha) ** k over all earlier values, divided by their sum."""
    out, num, den = np.full(len(x), np.nan), 0.0, 0.0
    for i, v in enumerate(x):
        num, den = num * (1 - alpha), den * (1 - alpha)
        if not np.isnan(v):
            num, den = num + v, den + 1
        if den > 0:
            out[i] = num / den
    return out


def ewm_window(x: np.ndarray, alpha: float, n: int) -> np.ndarray:
    """The adjusted mean over the last n values only, null until there are n."""
    w = (1 - alpha) ** np.arange(n - 1, -1, -1)
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n) @ (w / w.sum())
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder smoothing: the mean of the first n values, then (n - 1) parts old and one part new."""
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x))
    if not len(ok) or len(x) - ok[0] < n:
        return out
    at = ok[0] + n - 1
    e = x[ok[0] : at + 1].mean()
    out[at] = e
    for i in range(at + 1, len(x)):
        e = (e * (n - 1) + x[i]) / n
        out[i] = e
    return out


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def rsi_wilder(close: np.ndarray, n: int = 14) -> np.ndarray:
    """W11; 100 where the smoothed loss is 0."""
    d = np.diff(close, prepend=np.nan)
    g, l = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
    return np.where(l == 0, np.where(np.isnan(g), np.nan, 100.0), 100 - 100 / (1 + _over(g, l)))


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, signal and histogram, seeded with first values."""
    line = ema(close, fast) - ema(close, slow)
    s = ema(line, signal)
    return line, s, line - s


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    p = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - p), np.abs(low - p)))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder average of the true range from the second bar on."""
    t = true_range(high, low, close)
    t[:1] = np.nan
    return wilder(t, n)


def dmi(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI, ADX and ADXR."""
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(up), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    t = atr(high, low, close, n)
    p, m = 100 * _over(wilder(plus, n), t), 100 * _over(wilder(minus, n), t)
    dx = 100 * _over(np.abs(p - m), p + m)
    adx = wilder(np.where(np.isnan(p), np.nan, np.nan_to_num(dx)), n)
    back = np.concatenate([np.full(min(n - 1, len(adx)), np.nan), adx[: max(0, len(adx) - n + 1)]])
    return p, m, adx, (adx + back) / 2


def psar(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Parabolic stop and reverse; starts long if the second bar's upward move is no smaller than the downward one."""
    n = len(high)
    out = np.full(n, np.nan)
    if n < 2:
        return out
    long = high[1] - high[0] >= low[0] - low[1]
    sar, ep, af = (low[0], high[1], step) if long else (high[0], low[1], step)
    for i in range(1, n):
        if long:
            sar = min(sar, low[i - 1], low[i - 2] if i > 1 else low[i - 1])
            if low[i] <= sar:
                long, sar, ep, af = False, max(ep, high[i]), low[i], step
            elif high[i] > ep:
                ep, af = high[i], min(most, af + step)
        else:
            sar = max(sar, high[i - 1], high[i - 2] if i > 1 else high[i - 1])
            if high[i] >= sar:
                long, sar, ep, af = True, min(ep, low[i]), high[i], step
            elif low[i] < ep:
                ep, af = low[i], min(most, af + step)
        out[i] = sar
        sar += af * (ep - sar)
    return out


def smi(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 10, a: int = 3, b: int = 3, signal: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic momentum index and its signal; adjusted exponential means by span."""
    s = pd.Series
    hh, ll = s(high).rolling(n).max().to_numpy(), s(low).rolling(n).min().to_numpy()
    smooth = lambda x: ewm_adjusted(ewm_adjusted(x, 2 / (a + 1)), 2 / (b + 1))
    out = 100 * _over(smooth(close - (hh + ll) / 2), smooth((hh - ll) / 2))
    return out, ewm_adjusted(out, 2 / (signal + 1))


def garch(ret: np.ndarray, omega: float = 2.5e-5, a: float = 0.1, b: float = 0.85, seed: int = 20) -> np.ndarray:
    """Variance recursion with fixed parameters, seeded with the mean square of the first `seed` returns."""
    out = np.full(len(ret), np.nan)
    ok = np.flatnonzero(~np.isnan(ret))
    if len(ok) < seed:
        return out
    at = ok[seed - 1]
    v = float(np.mean(ret[ok[:seed]] ** 2))
    out[at] = v
    for i in range(at + 1, len(ret)):
        r = ret[i - 1]
        v = omega + a * (0.0 if np.isnan(r) else r * r) + b * v
        out[i] = v
    return out


def rank_so_far(x: np.ndarray) -> np.ndarray:
    """The share of the values up to each place that are no larger than the one there; NaN counts nowhere."""
    out, seen = np.full(len(x), np.nan), []
    for i, v in enumerate(x):
        if not np.isnan(v):
            bisect.insort(seen, v)
            out[i] = bisect.bisect_right(seen, v) / len(seen)
    return out


FIELDS = [
    "ema_12", "ema_26", "ema_rel_20", "ema_rel_40", "ema_delta_20_40", "ewm_03", "ewm_win", "rsi", "macd", "macd_signal", "macd_hist", "atr", "plus_di", "minus_di", "adx", "adxr",
    "sar_fast", "sar_slow", "smi", "smi_signal", "garch",
]


def compute(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> dict[str, np.ndarray]:
    """All recursive columns of one symbol's ordered bars; NaN where there is no value."""
    prev = np.concatenate([[np.nan], close[:-1]])
    ret = _over(close, np.where(prev == 0, np.nan, prev)) - 1
    e20, e40 = _over(ema(close, 20), close), _over(ema(close, 40), close)
    line, sig, hist = macd(close)
    p, m, adx, adxr = dmi(high, low, close)
    s, ss = smi(high, low, close)
    values = [
        ema(close, 12), ema(close, 26), e20, e40, e20 - e40, ewm_adjusted(ret, 0.3), ewm_window(ret, 0.1, 12), rsi_wilder(close), line, sig, hist, atr(high, low, close), p, m, adx, adxr,
        psar(high, low), psar(high, low, 0.01, 0.1), s, ss, garch(ret),
    ]
    return dict(zip(FIELDS, values, strict=True))


def per_symbol(bars: DataFrame, names: list[str], fn: Callable[[pd.DataFrame], dict[str, np.ndarray]], key: str = "symbol") -> DataFrame:
    """bars with the double columns that fn makes from one key's rows in ts order; NaN and infinities become null."""
    schema = T.StructType(bars.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        for n, v in fn(pdf).items():
            v = np.asarray(v, float)
            pdf[n] = pd.Series(np.where(np.isfinite(v), v, np.nan), index=pdf.index).astype(object).where(np.isfinite(v), None)
        return pdf

    return bars.groupBy(key).applyInPandas(run, schema)


def recursive_columns(bars: DataFrame) -> DataFrame:
    """bars with all FIELDS. A symbol's history is one task; bars are a few thousand a year and symbol."""
    return per_symbol(bars, FIELDS, lambda p: compute(p["high"].to_numpy(float), p["low"].to_numpy(float), p["close"].to_numpy(float)))


def ema_grid(bars: DataFrame, start: int = 20, end: int = 100, step: int = 20) -> DataFrame:
    """Bars with exponential means over close for every length from start up to (not with) end, and all their differences."""
    ns = list(range(start, end, step))
    pairs = [(a, b) for i, a in enumerate(ns) for b in ns[i + 1 :]]

    def run(p: pd.DataFrame) -> dict[str, np.ndarray]:
        c = p["close"].to_numpy(float)
        rel = {n: _over(ema(c, n), c) for n in ns}
        return {f"ema_rel_{n}": v for n, v in rel.items()} | {f"ema_delta_{a}_{b}": rel[a] - rel[b] for a, b in pairs}

    return per_symbol(bars, [f"ema_rel_{n}" for n in ns] + [f"ema_delta_{a}_{b}" for a, b in pairs], run)


def diversification(wide: DataFrame, columns: list[str], n: int = 60) -> DataFrame:
    """Ts and 1 - largest eigenvalue / trace of the covariance of the last n rows of wide columns; rows with a null don't count.

    Times are numbered by ranges. Blocks of a few thousand overlap by n rows, so a long calendar is spread over tasks; inside a block the
    covariances of all windows are differences of running sums of outer products, and their eigenvalues one call.
    """
    size = 20 * n
    x = numbered(wide.select("ts", *columns), ["ts"], "_i")
    block = F.floor(F.col("_i") / size)
    x = x.withColumn("_b", F.explode(F.array_distinct(F.array(block, F.floor((F.col("_i") + n - 1) / size)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        v, i, b = pdf[columns].to_numpy(float), pdf["_i"].to_numpy(), int(pdf["_b"].iloc[0])
        ok = ~np.isnan(v).any(1)
        v = np.where(ok[:, None], v - v[ok].mean(0), 0.0) if ok.any() else np.zeros_like(v)  # centred, so that the sums stay small
        upto = lambda s: np.concatenate([np.zeros((1, *s.shape[1:])), np.cumsum(s, 0)])
        hi = np.arange(1, len(v) + 1)
        lo = np.maximum(0, hi - n)
        count, first, second = (c[hi] - c[lo] for c in map(upto, (ok.astype(float), v, v[:, :, None] * v[:, None, :])))
        few = np.maximum(count, 2)
        cov = (second - first[:, :, None] * first[:, None, :] / few[:, None, None]) / (few - 1)[:, None, None]
        lam = np.linalg.eigvalsh(cov)
        total = lam.sum(1)
        good = (count >= 2) & (total > 1e-12 * np.maximum(1.0, np.abs(second).max((1, 2))))
        out = np.where(good, 1 - lam[:, -1] / np.where(good, total, 1.0), np.nan)
        keep = i // size == b
        return pd.DataFrame({"ts": pdf["ts"][keep], "diversification": pd.Series(out[keep]).astype(object).where(~np.isnan(out[keep]), None).to_numpy()})

    return x.groupBy("_b").applyInPandas(run, "ts timestamp_ntz, diversification double")
