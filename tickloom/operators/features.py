"""Feature sets: the standard one and one put together from builders and lengths."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.rolling import col, last_known, ratio, sma, std
from . import indicators as I
from . import recursive

STANDARD = ["return", "volatility", "momentum", "price_to_sma", "price_std", "rsi", "macd", "macd_signal", "bb_position", "skewness", "kurtosis"]


class Build(NamedTuple):
    """A builder of COLUMNS or FOLDS and the lengths that it is used with."""

    by: str
    lengths: tuple[int, ...]


#: Builders over windows: a length gives named columns. _r is the bar's return, _obv comes with indicators.with_flow.
COLUMNS: dict[str, Callable[[int], dict[str, Column]]] = {
    "mean": lambda n: {f"sma_{n}": sma("close", n)},
    "bands": lambda n: {k: v for k, v in I.bollinger(n, population=True).items() if k != "bb_pos"},
    "flow": lambda _: {"obv": I.volume_lines()["obv"]},
    "volume": lambda n: {f"volume_sma_{n}": sma("volume", n), f"volume_ratio_{n}": I.volume(n)["vol_ratio"]},
    "distance": lambda n: {f"price_to_sma_{n}": ratio(col("close"), sma("close", n)) - 1},
    "change": lambda n: {f"return_{n}": R.ret("close", n)},
    "deviation": lambda n: {f"volatility_{n}": std("_r", n)},
}
#: Builders over a symbol's ordered bars: a length, high, low and close give named arrays.
FOLDS: dict[str, Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]] = {
    "ema": lambda n, h, l, c: {f"ema_{n}": recursive.ema(c, n, seed="sma")},
    "rsi": lambda n, h, l, c: {f"rsi_{n}": recursive.rsi_wilder(c, n)},
    "macd": lambda n, h, l, c: dict(zip(("macd", "macd_signal", "macd_hist"), recursive.macd(c, slow=n), strict=True)),
    "range": lambda n, h, l, c: {"atr": recursive.atr(h, l, c, n)},
}
# The lengths that are used if nothing else is asked for.
USUAL = (
    Build("mean", (5, 10, 20, 50)), Build("ema", (5, 10, 20)), Build("rsi", (14,)), Build("macd", (26,)), Build("bands", (20,)), Build("range", (14,)), Build("flow", (1,)), Build("volume", (5,)),
    Build("distance", (5, 20, 50)), Build("change", (1, 3, 5)), Build("deviation", (5, 10)),
)


def standard_features(bars: DataFrame, n: int = 14, rsi: int = 14, band: int = 20, k: float = 2.0) -> DataFrame:
    """Symbol, ts and the features of STANDARD. A missing value is the last one known; rows before all are known are dropped.

    rsi averages the gains and losses of returns; the two exponential means are one grouped pass, the rest are windows.
    """
    x = recursive.per_symbol(bars, ["macd", "macd_signal"], lambda p: dict(zip(("macd", "macd_signal"), recursive.macd(p["close"].to_numpy(float))[:2], strict=True)))
    x = x.withColumn("return", R.ret())
    r, w = col("return"), R.frame(rsi)
    gain, loss = F.avg(F.greatest(r, F.lit(0.0))).over(w), F.avg(F.greatest(-r, F.lit(0.0))).over(w)
    full = F.count(r).over(w) == rsi
    m, s = sma("close", band), std("close", band)
    x = x.withColumns({
        "volatility": std("return", n), "momentum": sma("return", n), "price_to_sma": ratio(col("close"), sma("close", n)), "price_std": std("close", n),
        "rsi": F.when(full & (loss == 0) & (gain > 0), 100.0).when(full, 100 - 100 / (1 + ratio(gain, loss))),
        "bb_position": ratio(col("close") - (m - k * s), 2 * k * s), "skewness": R.skewness("return", n), "kurtosis": R.kurtosis("return", n),
    })
    return x.select("symbol", "ts", *(last_known(c).alias(c) for c in STANDARD)).dropna(subset=STANDARD)


def feature_pipeline(bars: DataFrame, builds: Sequence[Build] = USUAL, least: int = 10) -> DataFrame:
    """Bars with the columns of all builds; rows with a missing value are dropped.

    Symbols that are left with fewer than `least` rows give none. Recursive columns of all builds are one grouped pass. An unknown
    builder raises a KeyError.
    """
    folds = [(FOLDS[b.by], n) for b in builds if b.by not in COLUMNS for n in b.lengths]
    some = np.ones(1)
    made = [name for f, n in folds for name in f(n, some, some, some)]

    def run(p) -> dict[str, np.ndarray]:
        h, l, c = (p[k].to_numpy(float) for k in ("high", "low", "close"))
        return {name: v for f, n in folds for name, v in f(n, h, l, c).items()}

    x = recursive.per_symbol(bars, made, run) if made else bars
    x = (I.with_flow(x) if any(b.by == "flow" for b in builds) else x).withColumn("_r", R.ret())
    cols = {name: c for b in builds if b.by in COLUMNS for n in b.lengths for name, c in COLUMNS[b.by](n).items()}
    x = x.withColumns(cols).drop("_r", "_obv", "_ad").dropna(subset=[*made, *cols])
    return x.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("_n") >= least).drop("_n")
