"""Chart patterns over swings and peaks.

Swings are sparse, so lags run over the swing rows alone, and what they give is carried forward to all bars.
A swing is known only after its right side, so all patterns look `w` bars ahead of the swing itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.rolling import col, lag, last_known, ratio
from .scores import _above

# Weights of the patterns, and their ratios: B on XA, CD on AB, D on XA.
HARMONICS = {
    "gartley": (0.30, 0.618, 1.0, 0.786),
    "butterfly": (0.25, 0.786, 1.618, 1.27),
    "bat": (0.25, 0.382, 1.618, 0.886),
    "crab": (0.20, 0.382, 2.618, 1.618),
}


def confirmation(x: DataFrame, n: int = 20, factor: float = 2.0) -> DataFrame:
    """Adds confirmation: how far volume and range lie above their n-bar means, squashed."""
    x = x.withColumn("_w", col("high") - col("low"))
    return x.withColumn("confirmation", F.tanh((_above("volume", n) + _above("_w", n)) * factor)).drop("_w")


def extremes(x: DataFrame, c: str, w: int, sign: int, jump: float | None = None) -> Column:
    """Whether a bar's c lies strictly beyond the w bars on each side (sign 1: above), and by `jump` beyond the bar before."""
    v = sign * col(c)
    before, after = R.ordered().rowsBetween(-w, -1), R.ordered().rowsBetween(1, w)
    ok = (F.count(c).over(before) == w) & (F.count(c).over(after) == w) & (v > F.max(v).over(before)) & (v > F.max(v).over(after))
    if jump is not None:
        ok = ok & (v > sign * lag(c) * (1 + sign * jump))
    return F.coalesce(ok, F.lit(False))


def with_last(x: DataFrame, flag: str, values: list[str], n: int, out: str) -> DataFrame:
    """Adds `out`: the structs of the last n flagged rows up to each bar, oldest first; null until there are n."""
    w = Window.partitionBy("symbol", flag).orderBy("ts")
    item = F.struct(*values)
    back = [F.lag(item, k).over(w) for k in range(n - 1, 0, -1)]
    got = F.when(col(flag) & (F.row_number().over(w) >= n), F.array(*back, item))
    return x.withColumn("_got", got).withColumn(out, last_known("_got")).drop("_got")


def harmonics(bars: DataFrame, w: int = 5, jump: float = 0.01, tolerance: float = 0.05) -> DataFrame:
    """Adds a strength in [-1, 1] for each pattern of HARMONICS, and `harmonic`, their weighted sum.

    The last four swing highs H and lows L give the bullish points H1 L2 H3 L4 and the bearish L1 H2 L3 H4. A pattern
    holds if its three ratios lie within the tolerance of their targets; its strength is the mean closeness.
    """
    x = bars.withColumns({"_sh": extremes(bars, "high", w, 1, jump), "_sl": extremes(bars, "low", w, -1, jump)})
    x = with_last(with_last(x, "_sh", ["high"], 4, "_h"), "_sl", ["low"], 4, "_l")
    h, l = [F.get("_h", F.lit(i))["high"] for i in range(4)], [F.get("_l", F.lit(i))["low"] for i in range(4)]

    def strength(p: list[Column], targets: tuple[float, ...]) -> Column:
        got = [F.abs(ratio(p[2] - p[1], p[1] - p[0])), F.abs(ratio(p[3] - p[2], p[2] - p[1])), F.abs(ratio(p[3] - p[1], p[1] - p[0]))]
        near = [1 - F.abs(r - t) / (tolerance * t) for r, t in zip(got, targets, strict=True)]
        return F.when((near[0] >= 0) & (near[1] >= 0) & (near[2] >= 0), (near[0] + near[1] + near[2]) / 3).otherwise(0.0)

    for name, (_, *targets) in HARMONICS.items():
        up, down = strength([h[0], l[1], h[2], l[3]], tuple(targets)), strength([l[0], h[1], l[2], h[3]], tuple(targets))
        x = x.withColumn(name, ratio(up - down, (up > 0).cast("double") + (down > 0).cast("double")))
        x = x.withColumn(name, F.coalesce(name, F.lit(0.0)))
    total = sum((k[0] * col(n) for n, k in list(HARMONICS.items())[1:]), HARMONICS["gartley"][0] * col("gartley"))
    return x.withColumn("harmonic", total).drop("_sh", "_sl", "_h", "_l")


def formations(bars: DataFrame, w: int = 5, near: float = 0.02) -> DataFrame:
    """Adds head_shoulders, double, triangle and rectangle, each in [-1, 1].

    Head and shoulders compares prices at the peaks: the middle one of three beyond both others, which lie within `near` of
    each other, and two level troughs between. Doubles are two peaks (troughs) within `near`. Triangles come from
    the slopes through the last three highs and lows. Rectangles are breaks out of a channel whose bounds stay
    within `near` of their own mean. Volume between the outer points against that before scales the first two.
    """
    x = bars.withColumn("_i", F.row_number().over(R.ordered()).cast("double"))
    x = x.withColumn("_v", F.sum("volume").over(R.ordered().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumns({"_ph": extremes(x, "high", w, 1), "_pl": extremes(x, "low", w, -1), "_w5": R.sma("volume", 5)})
    x = with_last(with_last(x, "_ph", ["high", "_i", "_v", "_w5"], 3, "_h"), "_pl", ["low", "_i", "_v", "_w5"], 3, "_l")
    at = lambda a, i, f: F.get(a, F.lit(i))[f]

    def volume(a: str, i: int, bullish: bool) -> Column:
        r = ratio(ratio(at(a, 2, "_v") - at(a, i, "_v"), at(a, 2, "_i") - at(a, i, "_i")), at(a, i, "_w5"))
        r = F.coalesce(r, F.lit(1.0))
        return (F.least(r, F.lit(2.0)) if bullish else F.least(F.coalesce(ratio(F.lit(2.0), r), F.lit(2.0)), F.lit(2.0))) / 2

    close_to = lambda p, q: F.abs(ratio(p - q, p)) < near
    h, l = [at("_h", i, "high") for i in range(3)], [at("_l", i, "low") for i in range(3)]
    top = (h[1] > h[0]) & (h[1] > h[2]) & close_to(h[0], h[2]) & close_to(l[1], l[2])
    bottom = (l[1] < l[0]) & (l[1] < l[2]) & close_to(l[0], l[2]) & close_to(h[1], h[2])
    slope = lambda a, v: ratio(v[2] - v[0], at(a, 2, "_i") - at(a, 0, "_i"))
    up, down = ratio(slope("_h", h), h[2]), ratio(slope("_l", l), l[2])
    flat = near / 20
    channel_h, channel_l = R.highest("high", 20, end=-1), R.lowest("low", 20, end=-1)
    x = x.withColumns({"_ch": channel_h, "_cl": channel_l})
    steady = close_to(R.sma("_ch", 20), col("_ch")) & close_to(R.sma("_cl", 20), col("_cl"))
    return x.withColumns({
        "head_shoulders": F.when(top, -volume("_h", 0, False)).when(bottom, volume("_l", 0, True)).otherwise(0.0),
        "double": F.when(close_to(h[1], h[2]), -volume("_h", 1, False)).when(close_to(l[1], l[2]), volume("_l", 1, True)).otherwise(0.0),
        "triangle": F.when((F.abs(up) < flat) & (down > 0), 1.0).when((F.abs(down) < flat) & (up < 0), -1.0).when((up < 0) & (down > 0), F.signum(up + down) * 0.5).otherwise(0.0),
        "rectangle": F.when(steady & (col("high") > col("_ch")), 1.0).when(steady & (col("low") < col("_cl")), -1.0).otherwise(0.0),
    }).drop("_i", "_v", "_w5", "_ph", "_pl", "_h", "_l", "_ch", "_cl")
