"""Market regimes: the weighted score of eleven signals, regimes with hysteresis and their leverage (G30-G32), and families of scores.

Every column stands for the bar that it is on and looks at bars up to it; a score is null until all of its signals are known.
A regime follows from the score and the regime before. A bar's rule is a map of the three regimes to three regimes, and maps compose, so
long histories are folded by pieces like affine steps are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rolling as R
from ..functions.rolling import clamp, col, lag, ratio, sma
from . import candles, patterns, scan, scores
from . import indicators as I
from .prefix import dealt, kept, pieces

# Lengths and weights of the signals, the hysteresis and the leverage.
SHORT, LONG = 50, 200
GROUPS = {
    "primary": ["ma_cross", "price_ma", "ma_slope"], "momentum": ["macd_side", "rsi_zone", "adx_class"],
    "volatility": ["vol_class", "atr_trend", "band_zone"], "pattern": ["trend", "level_event"],
}
WEIGHTS = {"primary": 0.4 * 1.2, "momentum": 0.3, "volatility": 0.2, "pattern": 0.1}
SIGNALS = [s for names in GROUPS.values() for s in names]
NEUTRAL, KEPT = 0.2, 0.25
SURE, FAIRLY = 0.25, 0.3
REGIME_STEP, TREND_STEP, VOL_STEP = 0.5, 0.3, 0.2
PATTERN = {"candlestick": 0.30, "harmonic": 0.25, "chart": 0.25, "volume": 0.20}
CHART = {"level_signal": 0.30, "trend_signal": 0.25, "formation": 0.25, "channel": 0.20}
FORMATION = {"head_shoulders": 0.35, "double": 0.25, "triangle": 0.20, "rectangle": 0.20}


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def signals(x: DataFrame, short: int = SHORT, long: int = LONG, per_year: float = 365 * 24) -> DataFrame:
    """bars with rsi, adx, macd, macd_signal and atr: adds volatility and the SIGNALS, whole numbers from -2 to 2.

    Volatility is compared with half and double the symbol's first known one. All signals are null until the long average, the
    means of atr and the volatility are there.
    """
    x = x.withColumns({"_s": sma("close", short), "_l": sma("close", long), "_r": R.ret(), "_a5": sma("atr", 5), "_a20": sma("atr", 20)})
    x = x.withColumn("volatility", R.std("_r", 24) * math.sqrt(per_year))
    x = x.withColumn("_first", F.first("volatility", ignorenulls=True).over(R.ordered().rowsBetween(Window.unboundedPreceding, 0)))
    x = scores.classes(x)
    one = lambda c: F.when(c, 1).otherwise(-1)
    found = {
        "ma_cross": one(col("_s") > col("_l")), "price_ma": one(col("close") > col("_l")), "ma_slope": F.coalesce(F.signum(col("_l") - lag("_l", 5)).cast("int"), F.lit(0)),
        "macd_side": one(col("macd") > col("macd_signal")), "rsi_zone": col("rsi_zone"), "adx_class": scores.adx_class(),
        "vol_class": F.when(col("volatility") > 2 * col("_first"), 1).when(col("volatility") < 0.5 * col("_first"), -1).otherwise(0),
        "atr_trend": F.when(col("_a5") > col("_a20") * 1.1, 1).when(col("_a5") < col("_a20") * 0.9, -1).otherwise(0),
        "band_zone": col("band_zone"), "trend": col("trend"), "level_event": col("level_event"),
    }
    known = _sum([col(c) for c in ("_l", "_a20", "volatility", "adx", "rsi", "macd_signal")]).isNotNull()
    return x.withColumns({n: F.when(known, c) for n, c in found.items()}).drop("_s", "_l", "_r", "_a5", "_a20", "_first")


def trend_score() -> Column:
    """The groups' means by their weights."""
    return _sum([WEIGHTS[g] * _sum([col(n) for n in names]) / len(names) for g, names in GROUPS.items()])


def confidence() -> Column:
    """The share of the sign that most signals have, four fifths of it where volatility is out of the ordinary."""
    count = lambda f: _sum([f(col(s)).cast("int") for s in SIGNALS])
    most = F.greatest(count(lambda c: c > 0), count(lambda c: c < 0), count(lambda c: c == 0)) / len(SIGNALS)
    return F.when(col("vol_class") != 0, most * 0.8).otherwise(most)


def next_regimes(score: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Rows x 3, the regime after each bar for the regimes -1, 0 and 1 before it; an unknown score changes nothing.

    Up if the score is above a threshold, down if it is below the threshold's opposite, else neutral, given enough confidence.
    """
    out = np.zeros((len(score), 3), np.int8)
    for i, was in enumerate((-1, 0, 1)):
        limit = {-1: KEPT, 0: NEUTRAL, 1: -KEPT}[was]
        enough = sure > np.where(np.abs(score) > 0.3, SURE, FAIRLY)
        out[:, i] = np.where(np.isnan(score), was, np.where(enough & (score > limit), 1, np.where(enough & (score < -limit), -1, 0)))
    return out


def _follow(maps: np.ndarray, state: int) -> np.ndarray:
    out = np.empty(len(maps), np.int8)
    for i, m in enumerate(maps):
        out[i] = state = m[state + 1]
    return out


def regimes(x: DataFrame, score: str = "trend_score", sure: str = "confidence", key: str = "symbol") -> DataFrame:
    """Adds `regime` (-1, 0, 1), 0 before the first known score. A symbol's history is as many tasks as it has ranges."""
    schema, fields = x.schema, x.columns
    kind = schema[key].dataType.simpleString()
    x = dealt(x, [key, "ts"])

    def maps(p: pd.DataFrame) -> np.ndarray:
        return next_regimes(p[score].to_numpy(float), p[sure].to_numpy(float))

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        m = maps(p.sort_values("_at", kind="stable"))
        return pd.DataFrame({"_range": [p["_range"].iloc[0]], key: [p[key].iloc[0]], **{f"m{s}": [int(_follow(m, s)[-1])] for s in (-1, 0, 1)}})

    def starts(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_range")
        state, out = 0, []
        for m in p[["m-1", "m0", "m1"]].to_numpy():
            out.append(state)
            state = int(m[state + 1])
        return pd.DataFrame({"_range": p["_range"].to_numpy(), key: p[key].to_numpy(), "_start": out})

    def replay(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_at", kind="stable")
        out = p[fields].copy()
        out["regime"] = _follow(maps(p), int(p["_start"].iloc[0])).astype(int)
        return out

    each = x.select("_range", "_at", key, score, sure).groupBy("_range", key).applyInPandas(fold, f"_range long, {key} {kind}, `m-1` int, m0 int, m1 int")
    each = kept(each.groupBy(key).applyInPandas(starts, f"_range long, {key} {kind}, _start int"), "regimes")  # a row for each range of a symbol
    return x.join(each, ["_range", key]).groupBy("_range", key).applyInPandas(replay, T.StructType([*schema.fields, T.StructField("regime", T.IntegerType())]))


def momentum_score(equity: str = "close") -> Column:
    """Rising over 5, 10, 20 and 30 bars, averages in order, equity above them, and both short ones rising; 0 for less than 50 bars."""
    e = col(equity)
    back = {n: lag(equity, n - 1) for n in (5, 10, 20, 30)}
    means = {n: sma(equity, n) for n in back}
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    rising = _sum([yes(e > b) for b in back.values()]) / 4
    ordered = _sum([yes(means[a] > means[b]) for a, b in ((5, 10), (10, 20), (20, 30))]) / 3
    above = _sum([yes(e > m) for m in means.values()]) / 4
    total = 0.4 * rising + 0.3 * ordered + 0.2 * above + 0.1 * yes((e > back[5]) & (e > back[10]))
    return F.when(F.row_number().over(R.ordered()) >= 50, total).otherwise(0.0)


def leverage(x: DataFrame, equity: str = "close") -> DataFrame:
    """Adds leverage from regime, trend_score, confidence, volatility and an equity curve; null where the score is.

    A base that grows with regime and score, less for volatility (its place between half and double the first known one), a factor from
    weighted returns over 1, 5 and 20 bars (exp(4 r) for losses), a boost for momentum in calm and agreed markets, and bounds by regime.
    """
    e = col(equity)
    x = x.withColumns({
        "_v0": F.first("volatility", ignorenulls=True).over(R.ordered().rowsBetween(Window.unboundedPreceding, 0)), "_m": momentum_score(equity),
        "_d": F.when(F.row_number().over(R.ordered()) >= 20, 0.2 * (ratio(e, lag(equity)) - 1) + 0.3 * (ratio(e, lag(equity, 4)) - 1) + 0.5 * (ratio(e, lag(equity, 19)) - 1)).otherwise(0.0),
    })
    up = col("regime") > 0
    base = F.when(up, (2 + REGIME_STEP * 6 * (col("regime") + 1)) * (1 + TREND_STEP * 4 * (col("trend_score") + 1)))
    base = base.otherwise((1 + REGIME_STEP * (col("regime") + 1)) * (1 + TREND_STEP * (col("trend_score") + 1)))
    place = clamp(ratio(col("volatility") - 0.5 * col("_v0"), 1.5 * col("_v0")), 0.0, 1.0)
    calm = 1 - place * VOL_STEP * F.when(up, 0.2).otherwise(1.2)
    loss = F.when(col("_d") >= 0, 1 + col("_d")).otherwise(F.exp(4 * col("_d")))
    boost = F.least(F.lit(4.0), 1 + (col("_m") - 0.2) * 5 + (0.6 - place) * 3 + (col("confidence") - 0.4) * 3)
    boost = F.when((col("_m") > 0.2) & (place < 0.6) & (col("confidence") > 0.4), boost).otherwise(1.0)
    total = base * calm * loss * boost
    out = F.greatest(F.lit(1.0), F.least(F.when(up, 5.0).otherwise(2.5), total))
    return x.withColumn("leverage", F.when(total.isNotNull(), out)).drop("_v0", "_m", "_d")


def channel_score(n: int = 20, factor: float = 2.0) -> Column:
    """1 if the high breaks the channel of n bars up to the bar before, -1 if it lies below it, else its squashed place in the channel; 0 for a flat one."""
    up, low, h = R.highest("high", n), R.lowest("low", n), col("high")
    place = F.tanh(factor * 2 * ratio(h - (up + low) / 2, up - low))
    broken = F.when(h > R.highest("high", n, end=-1), 1.0).when(h < R.lowest("low", n, end=-1), -1.0).otherwise(place)
    return F.when(up.isNotNull() & low.isNotNull(), F.when(up <= low, 0.0).otherwise(broken))


def families(bars: DataFrame) -> DataFrame:
    """Symbol, ts and the trend, momentum, volatility and pattern scores of each symbol's last bar, and their blend.

    Each family is the limited weighted sum of its scores, the blend that of the families; null where a member lacks history.
    """
    from . import recursive
    from .pairs import latest

    x = recursive.recursive_columns(bars.withColumns(I.ichimoku() | I.bollinger()))
    x = I.with_money(x).withColumns({"mfi": I.mfi(14)} | {f"willr_{n}": I.williams(n) for n in scores.WILLR})
    x = scores.price_momentum_score(scores.bands_score(scores.ichimoku_score(scores.averages_score(x))))
    x = scores.yang_zhang_score(scores.parkinson_score(scores.garch_score(scores.historical_score(x))))
    x = x.withColumns({"dmi_score": scores.dmi_score(), "psar_score": scores.psar_score(), "rsi_score": scores.rsi_score(), "macd_score": scores.macd_score(), "smi_score": scores.smi_score(), "mfi_score": scores.mfi_score(), "willr_score": scores.williams_score()})
    members = lambda names, out: {n: f"{n}_score" for n in names} | out
    x = x.withColumns({
        "trend": scores.family(scores.TREND, members(scores.TREND, {})), "momentum": scores.family(scores.MOMENTUM, members(scores.MOMENTUM, {})),
        "volatility": scores.family(scores.VOLATILITY, members(scores.VOLATILITY, {})),
    })
    shapes = ["symbol", "ts", "candlestick_score", "harmonic", "trend_signal", "channel", "volume_score", *FORMATION]
    y = scores.volume_score(scores.trendline(patterns.formations(patterns.harmonics(candles.candlestick(bars))))).withColumn("channel", channel_score()).select(*shapes)
    out = latest(x.select("symbol", "ts", "trend", "momentum", "volatility")).join(latest(y).drop("ts"), "symbol")  # a row for each symbol
    out = out.join(scores.level_signal(bars, scores.levels(bars)), "symbol").withColumn("formation", _sum([w * col(n) for n, w in FORMATION.items()]))
    chart = scores.family(CHART, {n: n for n in CHART})
    out = out.withColumn("chart", chart)
    out = out.withColumn("pattern", scores.family(PATTERN, {"candlestick": "candlestick_score", "harmonic": "harmonic", "chart": "chart", "volume": "volume_score"}))
    return out.select("symbol", "ts", "trend", "momentum", "volatility", "pattern", scores.blend({n: n for n in scores.BLEND}).alias("blend"))


def detect(bars: DataFrame) -> DataFrame:
    """Bars with rsi, adx and others of scan.scanned_columns, the signals, trend_score, confidence, regime and leverage."""
    x = signals(scan.scanned_columns(bars))
    x = x.withColumns({"trend_score": trend_score(), "confidence": confidence()})
    return leverage(regimes(x))
