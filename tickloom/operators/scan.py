"""Recursive columns of very long histories, as a scan of affine maps.

Every smoothing step is x -> a x + b, and steps compose to one such map. Bars are dealt by ranges of (symbol, ts), so a long history is
many pieces. First each piece composes its steps; a small table, a row for each piece, then tells the state in which each
piece starts; last the piece replays its steps from there. Averages of averages (the signal of MACD, ADX) take a second
round, since their steps follow from the first one's results. A warm-up is part of the steps: until the n-th value a
mean gathers (a = 1, b = value / n), so a piece may begin anywhere in it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import dealt, kept, pieces
from .recursive import _over, true_range

Steps = tuple[np.ndarray, np.ndarray]


def smooth(v: np.ndarray, rank: np.ndarray, a: float) -> Steps:
    """Exponential mean with weight a for the new value, from the first value on; rank: how many values there are up to each row. NaN changes nothing."""
    has = ~np.isnan(v)
    first = has & (rank == 1)
    return np.where(first, 0.0, np.where(has, 1 - a, 1.0)), np.where(first, v, np.where(has, a * np.nan_to_num(v), 0.0))


def gather(v: np.ndarray, rank: np.ndarray, n: int, a: float, b: np.ndarray) -> Steps:
    """The mean of the first n values, then x -> a x + b. rank: of the value, from 1; 0 or less is no value."""
    warm = (rank >= 1) & (rank <= n)
    return np.where(rank > n, a, 1.0), np.where(warm, v / n, np.where(rank > n, b, 0.0))


def wilder(v: np.ndarray, rank: np.ndarray, n: int) -> Steps:
    """Wilder's mean: of the first n values, then n - 1 parts old and one part new."""
    return gather(v, rank, n, (n - 1) / n, v / n)


def compose(steps: Steps) -> tuple[float, float]:
    """The one map that does all steps."""
    a, b = steps
    return float(np.prod(a)), replay(steps, 0.0)[-1] if len(a) else 0.0


def replay(steps: Steps, start: float) -> np.ndarray:
    """The state after each step."""
    return np.fromiter(accumulate(zip(*steps, strict=True), lambda x, m: m[0] * x + m[1], initial=start), float, len(steps[0]) + 1)[1:]


class Piece:
    """Consecutive bars of a symbol and what the rounds need of the bar before them; `before` bars come earlier."""

    def __init__(self, p: pd.DataFrame, before: int, last: tuple):
        high, low, close = (p[c].to_numpy(float) for c in ("high", "low", "close"))
        self.close, n = close, len(close)
        pos = before + np.arange(n)  # of each bar in its symbol, from 0
        with_last = [np.concatenate([[np.nan if v is None else v], x]) for v, x in zip(last, (high, low, close), strict=True)]
        up, down, move = np.diff(with_last[0]), -np.diff(with_last[1]), np.diff(with_last[2])
        self.ret = _over(close, np.where(with_last[2][:-1] == 0, np.nan, with_last[2][:-1])) - 1
        self.pos = pos
        tr = true_range(*with_last)[1:]
        self.first = {
            "gain": wilder(np.maximum(move, 0), pos, 14), "loss": wilder(np.maximum(-move, 0), pos, 14), "tr": wilder(tr, pos, 14),
            "plus": wilder(np.where((up > down) & (up > 0), up, 0.0), pos, 14), "minus": wilder(np.where((down > up) & (down > 0), down, 0.0), pos, 14),
        }
        for steps in self.first.values():  # the first bar of a symbol has no change
            steps[1][pos == 0] = 0.0

    def exponential(self, values: dict[str, tuple[np.ndarray, int, float]]) -> dict[str, Steps]:
        """Steps of exponential means: name: (values, how many earlier ones, weight)."""
        return {k: smooth(v, seen + np.cumsum(~np.isnan(v)), a) for k, (v, seen, a) in values.items()}


def _rows(p: pd.DataFrame) -> pd.DataFrame:
    return p.sort_values("_at", kind="stable")


def _edges(x: DataFrame, key: str) -> DataFrame:
    """pieces() with the last high, low and close before each piece and how many closes and returns come earlier."""
    last = x.groupBy("_range", key).agg(F.max_by(F.struct("high", "low", "close"), "_at").alias("end"), F.count(F.when(~F.isnan("close"), F.col("close"))).alias("closes"))
    w = Window.partitionBy(key).orderBy("_range")
    t = pieces(x, key).join(last, ["_range", key])
    seen = F.coalesce(F.sum("closes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select("_range", key, "piece", "before", F.lag("end").over(w).alias("last"), seen.alias("seen"))


def _starts(maps: DataFrame, names: list[str], key: str) -> DataFrame:
    """The state of each name at the start of each piece, from the composed maps (a_<name>, b_<name>) of the pieces before."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("piece")
        out = p[["_range", key]].copy()
        for n in names:
            states = list(accumulate(zip(p[f"a_{n}"], p[f"b_{n}"], strict=True), lambda x, m: m[0] * x + m[1], initial=0.0))
            out[f"s_{n}"] = states[:-1]
        return out

    kind = maps.schema[key].dataType.simpleString()
    # a row for each piece of a symbol
    return maps.groupBy(key).applyInPandas(run, f"_range long, {key} {kind}, " + ", ".join(f"s_{n} double" for n in names))


def scan(bars: DataFrame, rounds: list[Callable[[Piece, dict[str, np.ndarray], int], dict[str, Steps]]], finish: Callable[[Piece, dict[str, np.ndarray]], dict[str, np.ndarray]], names: list[list[str]], fields: list[str], key: str = "symbol") -> DataFrame:
    """bars with the double columns `fields` that finish makes from the states of all rounds.

    rounds: each gives the steps of its names for a piece, from the states of the rounds before and the number of earlier closes. A state is NaN-free
    inside; finish decides from a bar's position where a value is null. NaN and infinities become null.
    """
    x = dealt(bars, [key, "ts"])
    edges = kept(_edges(x, key), "edges")
    kind = bars.schema[key].dataType.simpleString()
    columns, starts = bars.columns, []

    def states(p: pd.DataFrame, upto: int) -> tuple[Piece, dict[str, np.ndarray], int]:
        row = p.iloc[0]
        last = row["last"]
        last = (None, None, None) if last is None else tuple(last[c] if isinstance(last, dict) else getattr(last, c) for c in ("high", "low", "close"))
        piece, got, seen = Piece(p, int(row["before"]), last), {}, int(row["seen"])
        for k in range(upto):
            for n, steps in rounds[k](piece, got, seen).items():
                got[n] = replay(steps, float(row[f"s_{n}"]))
        return piece, got, seen

    def joined() -> DataFrame:
        t = x.join(edges, ["_range", key])
        for s in starts:
            t = t.join(s, ["_range", key])
        return t

    def folded(k: int, own: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def fold(p: pd.DataFrame) -> pd.DataFrame:
            p = _rows(p)
            maps = {n: compose(s) for n, s in rounds[k](*states(p, k)).items()}
            return pd.DataFrame({"_range": [p["_range"].iloc[0]], key: [p[key].iloc[0]], "piece": [p["piece"].iloc[0]], **{f"{c}_{n}": [maps[n][i]] for n in own for i, c in enumerate("ab")}})

        return fold

    for k, own in enumerate(names):
        maps = joined().groupBy("_range", key).applyInPandas(folded(k, own), f"_range long, {key} {kind}, piece int, " + ", ".join(f"{c}_{n} double" for n in own for c in "ab"))
        starts.append(kept(_starts(maps, own, key), "starts"))

    def last_round(p: pd.DataFrame) -> pd.DataFrame:
        p = _rows(p)
        piece, got, _ = states(p, len(rounds))
        out = p[columns].copy()
        for n, v in finish(piece, got).items():
            v = np.asarray(v, float)
            out[n] = pd.Series(np.where(np.isfinite(v), v, np.nan), index=out.index).astype(object).where(np.isfinite(v), None)
        return out

    return joined().groupBy("_range", key).applyInPandas(last_round, T.StructType(bars.schema.fields + [T.StructField(n, T.DoubleType()) for n in fields]))


OMEGA, ALPHA, BETA = 2.5e-5, 0.1, 0.85
FIRST = ["e12", "e20", "e26", "e40", "num", "den", "gain", "loss", "tr", "plus", "minus", "garch"]
SECOND = ["signal", "dx"]
FIELDS = ["ema_12", "ema_26", "ema_rel_20", "ema_rel_40", "ema_delta_20_40", "ewm_03", "rsi", "macd", "macd_signal", "macd_hist", "atr", "plus_di", "minus_di", "adx", "garch"]


def _first(x: Piece, _: dict[str, np.ndarray], seen: int) -> dict[str, Steps]:
    out = x.exponential({f"e{n}": (x.close, seen, 2 / (n + 1)) for n in (12, 20, 26, 40)})
    has = ~np.isnan(x.ret)
    out["num"] = np.full(len(has), 0.7), np.where(has, np.nan_to_num(x.ret), 0.0)
    out["den"] = np.full(len(has), 0.7), has.astype(float)
    # the state is the variance of the next bar; the mean square of the first 20 returns starts it
    square = np.nan_to_num(x.ret) ** 2
    step = OMEGA + ALPHA * square
    out["garch"] = np.where(x.pos < 20, 1.0, BETA), np.where(x.pos < 1, 0.0, np.where(x.pos < 20, square / 20, np.where(x.pos == 20, BETA * square / 20 + step, step)))
    return out | x.first


def _dmi(x: Piece, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, m = 100 * _over(s["plus"], s["tr"]), 100 * _over(s["minus"], s["tr"])
    return p, m, np.nan_to_num(100 * _over(np.abs(p - m), p + m))


def _second(x: Piece, s: dict[str, np.ndarray], seen: int) -> dict[str, Steps]:
    line = np.where(seen + np.cumsum(~np.isnan(x.close)) > 0, s["e12"] - s["e26"], np.nan)
    rank = np.maximum(0, seen + np.cumsum(~np.isnan(x.close)))
    return {"signal": smooth(line, rank, 0.2), "dx": wilder(_dmi(x, s)[2], x.pos - 13, 14)}


def _finish(x: Piece, s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    late = lambda v, n: np.where(x.pos >= n, v, np.nan)
    rel20, rel40, line = _over(s["e20"], x.close), _over(s["e40"], x.close), s["e12"] - s["e26"]
    p, m, _ = _dmi(x, s)
    rsi = np.where(s["loss"] == 0, 100.0, 100 - 100 / (1 + _over(s["gain"], s["loss"])))
    variance = (s["garch"] - OMEGA - ALPHA * np.nan_to_num(x.ret) ** 2) / BETA  # of this bar
    values = [
        s["e12"], s["e26"], rel20, rel40, rel20 - rel40, _over(s["num"], s["den"]), late(rsi, 14), line, s["signal"], line - s["signal"], late(s["tr"], 14), late(p, 14), late(m, 14), late(s["dx"], 27), late(variance, 20),
    ]
    return dict(zip(FIELDS, values, strict=True))


def scanned_columns(bars: DataFrame) -> DataFrame:
    """bars (symbol, ts, high, low, close; one row a symbol and time, prices not null) with FIELDS, equal to those of recursive.recursive_columns to rounding.

    A symbol's history is as many tasks as it has ranges. An empty table gives an empty result.
    """
    return scan(bars, [_first, _second], _finish, [FIRST, SECOND], FIELDS)


def ema_grid(bars: DataFrame, start: int = 20, end: int = 100, step: int = 20) -> DataFrame:
    """W8 by scan: bars with exponential means over close for every length from start up to (not with) end, and all their differences."""
    ns = list(range(start, end, step))
    pairs = [(a, b) for i, a in enumerate(ns) for b in ns[i + 1 :]]

    def steps(x: Piece, _: dict[str, np.ndarray], seen: int) -> dict[str, Steps]:
        return x.exponential({f"e{n}": (x.close, seen, 2 / (n + 1)) for n in ns})

    def finish(x: Piece, s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        rel = {n: _over(s[f"e{n}"], x.close) for n in ns}
        return {f"ema_rel_{n}": v for n, v in rel.items()} | {f"ema_delta_{a}_{b}": rel[a] - rel[b] for a, b in pairs}

    return scan(bars, [steps], finish, [[f"e{n}" for n in ns]], [f"ema_rel_{n}" for n in ns] + [f"ema_delta_{a}_{b}" for a, b in pairs])
