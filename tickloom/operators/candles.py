"""Candle shapes as signed strengths, and their composite.

A strength lies in [-2, 2], is positive where the shape is bullish and 0 where it isn't there or a bar it needs is missing.
The trend that tells a hammer from a hanging man is that of the body sizes, as in the rule that this follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import col, lag, ratio, sma
from .patterns import confirmation
from .scores import weighted

# Weights within each family and of the families.
SINGLE = {"hammer": 0.35, "shooting_star": 0.35, "doji": 0.30}
DOUBLE = {"engulfing": 0.4, "harami": 0.3, "tweezer": 0.3}
TRIPLE = {"star": 0.3, "soldiers": 0.3, "inside": 0.2, "outside": 0.2}
FAMILIES = {"single": 0.25, "double": 0.30, "triple": 0.30, "confirmation": 0.15}
#: The most that a strength counts.
MOST = 2.0


def _share(a: Column, b: Column) -> Column:
    return F.least(F.coalesce(ratio(a, b), F.lit(MOST)), F.lit(MOST))


def _signed(bull: Column, bear: Column, strength: Column | float) -> Column:
    s = strength if isinstance(strength, Column) else F.lit(strength)
    return F.when(bull, s).when(bear, -s).otherwise(0.0)


def single(x: DataFrame, n: int = 20, short: int = 5) -> DataFrame:
    """Adds hammer (negative: hanging man), shooting_star and doji."""
    o, h, l, c = (col(k) for k in ("open", "high", "low", "close"))
    x = x.withColumns({"_body": F.abs(c - o), "_up": h - F.greatest(o, c), "_down": F.least(o, c) - l})
    x = x.withColumns({"_avg": sma("_body", n), "_trend": sma("_body", short) - sma("_body", n)})
    body, up, down, avg, falling = col("_body"), col("_up"), col("_down"), col("_avg"), col("_trend") < 0
    hammer = (up <= body * 0.25) & (down >= body * 2.0) & (body >= avg * 0.3)
    star = (up >= body * 2.0) & (down <= body * 0.25) & (body <= avg * 0.3)
    doji = body <= avg * 0.1
    long = lambda tail: F.when(body == 0, 0.0).otherwise(_share(tail, body * 2.0))
    flat = F.when(avg == 0, 1.0).otherwise(1 - ratio(body, avg * 0.1))
    x = x.withColumns({
        "hammer": _signed(hammer & falling, hammer, long(down)),
        "shooting_star": F.when(star & (col("_trend") > 0), -long(up)).otherwise(0.0),
        "doji": _signed(doji & falling, doji, flat),
    })
    return x.drop("_body", "_up", "_down", "_avg", "_trend")


def double(x: DataFrame, n: int = 20) -> DataFrame:
    """Adds engulfing, harami and tweezer (equal highs before equal lows)."""
    o, c, po, pc = col("open"), col("close"), lag("open"), lag("close")
    body, before = F.abs(c - o), F.abs(pc - po)
    x = x.withColumn("_range", col("high") - col("low"))
    near = sma("_range", n) * 0.001
    small = body <= before * 0.6
    return x.withColumns({
        "engulfing": _signed((pc < po) & (c > o) & (o < pc) & (c > po), (pc > po) & (c < o) & (o > pc) & (c < po), _share(body, before)),
        "harami": _signed((pc < po) & (c > o) & (o > pc) & (c < po) & small, (pc > po) & (c < o) & (o < pc) & (c > po) & small, 1.0),
        "tweezer": F.when((F.abs(col("high") - lag("high")) <= near) & (col("_range") > 0), -1.0).when((F.abs(col("low") - lag("low")) <= near) & (col("_range") > 0), 1.0).otherwise(0.0),
    }).drop("_range")


def triple(x: DataFrame) -> DataFrame:
    """Adds star (morning, evening), soldiers (white soldiers, black crows), inside and outside (three bars up, down)."""
    o = [lag("open", 2), lag("open"), col("open")]
    h, l = [lag("high", 2), lag("high"), col("high")], [lag("low", 2), lag("low"), col("low")]
    c = [lag("close", 2), lag("close"), col("close")]
    b = [F.abs(c[i] - o[i]) for i in range(3)]
    up, down = [c[i] > o[i] for i in range(3)], [c[i] < o[i] for i in range(3)]
    total, middle = b[0] + b[1] + b[2], (o[0] + c[0]) / 2
    small = b[1] < total / 3 * 0.25
    rise = up[0] & up[1] & up[2] & (c[1] > c[0]) & (c[2] > c[1]) & (o[1] > o[0]) & (o[2] > o[1])
    fall = down[0] & down[1] & down[2] & (c[1] < c[0]) & (c[2] < c[1]) & (o[1] < o[0]) & (o[2] < o[1])
    for i in range(3):
        rise = rise & (h[i] - F.greatest(o[i], c[i]) <= b[i] * 0.2)
        fall = fall & (F.least(o[i], c[i]) - l[i] <= b[i] * 0.2)
    held = b[1] < b[0] * 0.7
    on_up, on_down = up[2] & (c[2] > c[1]), down[2] & (c[2] < c[1])
    last = _share(b[2], b[0])
    return x.withColumns({
        "star": _signed(down[0] & small & up[2] & (c[2] > middle), up[0] & small & down[2] & (c[2] < middle), last),
        "soldiers": _signed(rise, fall, _share(total, b[0] * 3)),
        "inside": _signed(down[0] & up[1] & held & on_up, up[0] & down[1] & held & on_down, last),
        "outside": _signed(down[0] & up[1] & (o[1] < c[0]) & (c[1] > o[0]) & on_up, up[0] & down[1] & (o[1] > c[0]) & (c[1] < o[0]) & on_down, last),
    })


def candlestick(bars: DataFrame) -> DataFrame:
    """Adds all shapes, confirmation and candlestick_score, the limited weighted sum of the families; null without 20 bars."""
    x = confirmation(triple(double(single(bars))))
    family = lambda weights: sum((w * col(k) for k, w in list(weights.items())[1:]), next(iter(weights.values())) * col(next(iter(weights))))
    parts = {"single": family(SINGLE), "double": family(DOUBLE), "triple": family(TRIPLE), "confirmation": col("confirmation")}
    return x.withColumn("candlestick_score", weighted([(FAMILIES[k], c) for k, c in parts.items()]))
