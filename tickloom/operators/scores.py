"""Signal scores per bar, each limited to [-1, 1].

A score is a weighted sum of parts. Look-backs of d bars compare with the bar d - 1 before. A part whose
divisor is 0 or that lacks history makes the score null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.rolling import clamp, col, lag, ratio, sma, squash
from . import recursive

# Weights and scales of the scores.
TREND = {"ma": 0.25, "ichimoku": 0.25, "dmi": 0.20, "psar": 0.15, "bands": 0.15}
MOMENTUM = {"rsi": 0.2, "macd": 0.2, "price": 0.2, "smi": 0.2, "mfi": 0.1, "willr": 0.1}
BLEND = {"trend": 0.4, "momentum": 0.3, "volatility": 0.2, "pattern": 0.1}
ROC = {5: 0.4, 10: 0.3, 20: 0.2, 30: 0.1}
WILLR = {14: 0.5, 28: 0.3, 42: 0.2}


def side(c: Column) -> Column:
    """1 above 0, else -1."""
    return F.when(c > 0, 1.0).otherwise(-1.0)


def weighted(parts: dict[float, Column] | list[tuple[float, Column]]) -> Column:
    """The limited weighted sum; null if a part is."""
    items = list(parts.items()) if isinstance(parts, dict) else parts
    total = items[0][0] * items[0][1]
    for w, c in items[1:]:
        total = total + w * c
    return F.when(total.isNotNull(), clamp(total))


def change(c: str | Column, d: int) -> Column:
    """Relative change against the bar d - 1 before."""
    return ratio(col(c) - lag(c, d - 1), lag(c, d - 1))


def cross_event(fast: str, slow: str) -> Column:
    """G1: 1 where fast crosses above slow, -1 below, else 0."""
    now, was = col(fast) - col(slow), lag(fast) - lag(slow)
    return F.when((now > 0) & (was <= 0), 1).when((now < 0) & (was >= 0), -1).otherwise(0)


def cross_state(fast: str, slow: str) -> Column:
    """1 while fast is above slow, else -1; null without both."""
    return F.when(col(fast) > col(slow), 1).when(col(fast).isNotNull() & col(slow).isNotNull(), -1)


def average_rsi_rule(short: str, long: str, rsi: str) -> Column:
    """SELL if short > long and RSI > 70, BUY if short < long and RSI < 30."""
    return F.when((col(short) > col(long)) & (col(rsi) > 70), "SELL").when((col(short) < col(long)) & (col(rsi) < 30), "BUY")


def averages_score(x: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """Adds ma_score from cross, position, slope and spread of two averages."""
    x = x.withColumns({"_s": sma("close", short), "_l": sma("close", long)})
    x = x.withColumns({"_gap": ratio(F.abs(col("_s") - col("_l")), col("_l")), "_c": clamp(ratio(col("_s") - col("_l"), col("_l") * 0.02))})
    x = x.withColumn("_h", sma("_gap", 20))
    cross = F.when(col("_s").isNotNull() & col("_l").isNotNull(), col("_c"))
    place = ratio(col("close") - col("_s"), col("_s")) + ratio(col("close") - col("_l"), col("_l"))
    slope = change("_s", 5) + change("_l", 5)
    spread = ratio(col("_gap"), col("_h"))
    lim = lambda c: F.when(c.isNotNull(), clamp(c * 50))
    score = weighted([(0.35, cross), (0.25, lim(place)), (0.25, lim(slope)), (0.15, F.when(spread.isNotNull(), F.least(spread, F.lit(2.0)) / 2 * side(col("_c"))))])
    return x.withColumn("ma_score", score).drop("_s", "_l", "_gap", "_c", "_h")


def ichimoku_score(x: DataFrame) -> DataFrame:
    """Adds ichimoku_score from tenkan, kijun, senkou_a and senkou_b: place against the cloud, cross, thickness, momentum."""
    ok = col("senkou_a").isNotNull() & col("senkou_b").isNotNull()
    top, bottom = F.when(ok, F.greatest("senkou_a", "senkou_b")), F.when(ok, F.least("senkou_a", "senkou_b"))
    thick, p = top - bottom, col("close")
    x = x.withColumns({"_top": top, "_bot": bottom, "_th": thick})
    place = F.when(p > col("_top"), F.least(ratio(p - col("_top"), col("_th")), F.lit(1.0))).when(p < col("_bot"), F.greatest(ratio(p - col("_bot"), col("_th")), F.lit(-1.0))).otherwise(ratio(p - col("_bot"), col("_th")) - 0.5)
    x = x.withColumns({"_p": F.when(col("_th") > 0, place), "_mid": sma((col("high") + col("low")) / 2, 26)})
    cross, mom, size = ratio(col("tenkan") - col("kijun"), col("_th") * 0.5), change("close", 5) * 20, ratio(col("_th"), col("_mid") * 0.1)
    lim = lambda c: F.when(c.isNotNull(), clamp(c))
    score = weighted([(0.4, col("_p")), (0.3, lim(cross)), (0.1, F.when(size.isNotNull(), F.least(size, F.lit(1.0)) * side(col("_p")))), (0.2, lim(mom))])
    return x.withColumn("ichimoku_score", score).drop("_top", "_bot", "_th", "_p", "_mid")


def dmi_score() -> Column:
    """From plus_di, minus_di and adx: relative strength, trend strength and its change, intensity of the crossover."""
    p, m, a = col("plus_di"), col("minus_di"), col("adx")
    rel = F.when(p + m > 0, (p - m) / (p + m)).when((p + m).isNotNull(), 0.0)
    strong = F.when(a.isNotNull(), F.least(a / 50, F.lit(1.0)))
    mom, step = change("adx", 5) * 10, ((p - m) - (lag("plus_di") - lag("minus_di"))) / 5
    lim = lambda c: F.when(c.isNotNull(), clamp(c))
    return weighted([(0.4, rel * strong), (0.3, strong * side(rel)), (0.15, lim(mom) * side(rel)), (0.15, lim(step))])


def psar_score() -> Column:
    """From sar_fast and sar_slow: side and capped distance of both, flips of the fast one, velocity."""
    c, f, s = col("close"), col("sar_fast"), col("sar_slow")
    near = lambda v: F.when(v.isNotNull() & (c != 0), F.least(F.abs(c - v) / c / 0.05, F.lit(1.0)) * side(c - v))
    flip = F.when((lag("sar_fast") > lag("close")) & (c > f), 1.0).when((lag("sar_fast") < lag("close")) & (c < f), -1.0).otherwise(0.0)
    v = change("close", 5) * 20
    return weighted([(0.3, near(f)), (0.3, near(s)), (0.2, flip), (0.2, F.when(v.isNotNull(), clamp(v)))])


def bands_score(x: DataFrame) -> DataFrame:
    """Adds bands_score from bb_up, bb_mid and bb_low. The bandwidth is compared with its own 20-bar mean."""
    x = x.withColumn("_bw", ratio(col("bb_up") - col("bb_low"), col("bb_mid")))
    x = x.withColumn("_m", sma("_bw", 20))
    width = col("bb_up") - col("bb_low")
    place = 2 * (F.when(width > 0, (col("close") - col("bb_low")) / width).when(width.isNotNull(), 0.0) - 0.5)
    wide = ratio(col("_bw"), col("_m"))
    slope, v = change("bb_mid", 5) * 20, change("close", 5) * 20
    lim = lambda c: F.when(c.isNotNull(), clamp(c))
    score = weighted([(0.35, place), (0.25, F.when(wide.isNotNull(), F.least(wide, F.lit(2.0)) / 2 * side(place))), (0.2, lim(slope)), (0.2, lim(v))])
    return x.withColumn("bands_score", score).drop("_bw", "_m")


def rsi_score(c: str = "rsi") -> Column:
    """Centred RSI, its change, and what lies beyond 70 and 30."""
    r = col(c)
    beyond = F.when(r >= 70, (r - 70) / 30).when(r <= 30, (r - 30) / 30).otherwise(0.0)
    return weighted([(0.6, (r - 50) / 50), (0.2, (r - lag(c)) / 100), (0.2, beyond)])


def _crossing(a: Column, b: Column, size: Column) -> Column:
    """1 or -1 where a difference (now a, before b) changes sign, else the sized difference."""
    return F.when((a > 0) & (b <= 0), 1.0).when((a < 0) & (b >= 0), -1.0).otherwise(size)


def macd_score() -> Column:
    """From macd, macd_signal and macd_hist: crossing, strength and change of the histogram, change and side of the line."""
    m, h, tiny = col("macd"), col("macd_hist"), 1e-8
    now, was = m - col("macd_signal"), lag("macd") - lag("macd_signal")
    by = F.abs(m) + tiny
    lim = lambda c: F.when(c.isNotNull(), clamp(c))
    return weighted([(0.3, _crossing(now, was, now / by)), (0.2, lim(h / by)), (0.2, lim((h - lag("macd_hist")) / (F.abs(h) + tiny))), (0.15, lim((m - lag("macd")) / by)), (0.15, lim(m / by))])


def price_momentum_score(x: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """Adds price_score from rates of change, acceleration, convergence of averages and velocity against atr."""
    x = x.withColumns({"_v": R.ret(), "_cv": ratio(sma("close", short) - sma("close", long), sma("close", long))})
    roc = sum((w * squash(change("close", d), 0.1) for d, w in list(ROC.items())[1:]), ROC[5] * squash(change("close", 5), 0.1))
    acc, conv = squash(col("_v") - lag("_v"), 0.02), squash(col("_cv") - lag("_cv"), 0.05)
    vel = squash(ratio(col("close") - lag("close", 4), col("atr") * 5), 2.0)
    return x.withColumn("price_score", weighted([(0.35, roc), (0.25, acc), (0.2, conv), (0.2, vel)])).drop("_v", "_cv")


def smi_score() -> Column:
    """From smi and smi_signal: level, change, crossing, and what lies beyond 40."""
    s = col("smi")
    now, was = s - col("smi_signal"), lag("smi") - lag("smi_signal")
    beyond = F.when(F.abs(s) > 40, (F.abs(s) - 40) / 60 * F.signum(s)).otherwise(0.0)
    return weighted([(0.4, s / 100), (0.2, (s - lag("smi")) / 100), (0.25, _crossing(now, was, now / 100)), (0.15, beyond)])


def mfi_score(c: str = "mfi") -> Column:
    """Centred money flow, its change, what lies beyond 80 and 20 (against it), and its divergence from price."""
    m = col(c)
    beyond = F.when(m >= 80, -(m - 80) / 20).when(m <= 20, (20 - m) / 20).otherwise(0.0)
    div = ((m - lag(c, 9)) / 100 - change("close", 10)) * 5
    return weighted([(0.35, (m - 50) / 50), (0.25, (m - lag(c)) / 100), (0.2, beyond), (0.2, F.when(div.isNotNull(), clamp(div)))])


def williams_score() -> Column:
    """From willr_14, willr_28 and willr_42: level, change, extremes, three lengths together, and reversals within 5 bars."""
    w = col("willr_14")
    beyond = F.when(w >= -20, (-20 - w) / 20).when(w <= -80, -(w + 80) / 20).otherwise(0.0)
    many = sum((k * (col(f"willr_{n}") + 50) / 50 for n, k in list(WILLR.items())[1:]), WILLR[14] * (w + 50) / 50)
    lo, hi = R.lowest("willr_14", 5), R.highest("willr_14", 5)
    turn = F.when((lo <= -80) & (w > -80), 1.0).when((hi >= -20) & (w < -20), -1.0).otherwise(0.0)
    return weighted([(0.3, (w + 50) / 50), (0.2, (w - lag("willr_14")) / 100), (0.2, beyond), (0.15, many), (0.15, turn)])


def family(weights: dict[str, float], columns: dict[str, str]) -> Column:
    """Weighted sum of a family's scores, limited."""
    return weighted([(w, col(columns[n])) for n, w in weights.items()])


def classes(x: DataFrame) -> DataFrame:
    """Adds rsi_zone (2 to -2, from rsi), band_zone (2 above the upper band, 1 above the middle, mirrored below), trend
    (1 if the price lies above the means of 10, 20 and 50 bars and these fall in this order, -1 mirrored) and level_event
    (1 breakout or bounce, -1 breakdown or rejection at the high and low of 10 bars), each 0 otherwise."""
    c, p, r = col("close"), lag("close"), col("rsi")
    m, d = sma("close", 20), R.std("close", 20)
    a, b, e = sma("close", 10), sma("close", 20), sma("close", 50)
    hi, lo = R.highest("high", 10), R.lowest("low", 10)
    near_hi, near_lo = F.abs(ratio(hi - c, hi)) < 0.01, F.abs(ratio(c - lo, c)) < 0.01
    event = F.when((c > hi) & (p < hi), 1).when((c < lo) & (p > lo), -1).when(near_hi & (c < p), -1).when(near_lo & (c > p), 1).otherwise(0)
    return x.withColumns({
        "rsi_zone": F.when(r > 70, 2).when(r > 60, 1).when(r < 30, -2).when(r < 40, -1).otherwise(0),
        "band_zone": F.when(c > m + 2 * d, 2).when(c > m, 1).when(c < m - 2 * d, -2).when(c < m, -1).otherwise(0),
        "trend": F.when((c > a) & (c > b) & (c > e) & (a > b) & (b > e), 1).when((c < a) & (c < b) & (c < e) & (a < b) & (b < e), -1).otherwise(0),
        "level_event": event,
    })


def adx_class(c: str = "adx") -> Column:
    """2 very strong, 1 strong, -1 weak, 0 between."""
    return F.when(col(c) > 40, 2).when(col(c) > 25, 1).when(col(c) < 15, -1).otherwise(0)


def volatility_class(x: DataFrame, c: str = "vol") -> DataFrame:
    """Low, normal or high against half and double the symbol's first known volatility."""
    first = F.first(c, ignorenulls=True).over(R.ordered().rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("vol_class", F.when(col(c).isNull(), None).when(col(c) < 0.5 * first, "low").when(col(c) > 2 * first, "high").otherwise("normal"))


def agreement(signals: list[str]) -> dict[str, Column]:
    """Mean of the signals, and the share of the sign that most of them have."""
    n = len(signals)
    count = lambda f: sum((f(col(s)).cast("int") for s in signals[1:]), f(col(signals[0])).cast("int"))
    most = F.greatest(count(lambda c: c > 0), count(lambda c: c < 0), count(lambda c: c == 0))
    return {"trend_score": sum((col(s) for s in signals[1:]), col(signals[0])) / n, "confidence": most / n}


def leverage(vol_rank: Column, drawdown: Column, momentum: Column, least: float = 0.2, most: float = 3.0) -> Column:
    """Bounded product of a factor that falls with the volatility's rank, exp(4 drawdown), and a momentum boost."""
    return clamp((1.5 - vol_rank) * F.exp(4 * drawdown) * (1 + 0.5 * F.tanh(momentum * 10)), least, most)


def order_side(prediction: Column, threshold: float = 0.001, shorts: bool = True) -> dict[str, Column]:
    """BUY, SELL or HOLD by a threshold on the prediction; confidence is its size."""
    return {"side": F.when(prediction > threshold, "BUY").when((prediction < -threshold) & F.lit(shorts), "SELL").otherwise("HOLD"), "confidence": F.abs(prediction)}


def synthetic_index(bars: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sums of high, low and close at each time (symbol, weight)."""
    x = bars.join(weights, "symbol")
    return x.groupBy("ts").agg(*(F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("high", "low", "close")))


# Weights of the volatility scores and their lengths.
VOLATILITY = {"historical": 0.30, "garch": 0.25, "parkinson": 0.25, "yang_zhang": 0.20}
HIST = {5: 0.4, 10: 0.3, 21: 0.2, 63: 0.1}
PARKINSON = {5: 0.5, 10: 0.3, 21: 0.2}


def _above(c: str, n: int) -> Column:
    """Relative distance from the n-bar mean, 0 where that is 0."""
    m = sma(c, n)
    return F.when(m == 0, 0.0).otherwise((col(c) - m) / F.nullif(m, F.lit(0.0)))


def historical_score(x: DataFrame) -> DataFrame:
    """Adds historical_score from return deviations over four lengths: trend, regime, shape of returns, term structure.

    Kurtosis is already in excess of the normal's, and 3 more is taken off, as in the rule that this follows.
    """
    x = x.withColumn("_r", R.ret())
    x = x.withColumns({f"_v{n}": R.std("_r", n) * 252**0.5 for n in HIST})
    trend = sum((w * squash(_above(f"_v{n}", 21), 0.5) for n, w in list(HIST.items())[1:]), HIST[5] * squash(_above("_v5", 21), 0.5))
    regime = squash(F.when(col("_v21") == 0, 0.0).otherwise(col("_v5") / F.nullif("_v21", F.lit(0.0))) - 1, 0.5)
    shape = F.tanh(0.4 * R.skewness("_r", 63) + 0.6 * (R.kurtosis("_r", 63) - 3))
    slope = (-1.5 * col("_v5") - 0.5 * col("_v10") + 0.5 * col("_v21") + 1.5 * col("_v63")) / 5
    score = weighted([(0.35, trend), (0.25, regime), (0.2, shape), (0.2, squash(slope, 0.5))])
    return x.withColumn("historical_score", score).drop("_r", *(f"_v{n}" for n in HIST))


def garch_score(x: DataFrame, persistence: int = 60) -> DataFrame:
    """Adds garch_score from column garch (a variance): trend, autocorrelation at lag 5, shocks, forecast slope.

    The autocorrelation runs over `persistence` bars, so that a bar's score doesn't depend on the length of its history.
    """
    x = x.withColumns({"_g": F.sqrt("garch"), "_r": R.ret()})
    x = x.withColumns({"_l": lag("_g", 5), "_s": F.abs(ratio(col("_r"), col("_g"))), "_n": F.row_number().over(R.ordered()).cast("double")})
    w, f = R.frame(persistence), R.frame(10)
    auto = F.when(F.count("_l").over(w) == persistence, F.corr("_g", "_l").over(w))
    slope = F.when(F.count("_g").over(f) == 10, F.regr_slope("_g", "_n").over(f))
    score = weighted([(0.3, squash(_above("_g", 21), 0.5)), (0.25, squash(auto, 0.5)), (0.25, squash(sma("_s", 5), 0.5)), (0.2, squash(slope, 0.5))])
    return x.withColumn("garch_score", score).drop("_g", "_r", "_l", "_s", "_n")


def parkinson_score(x: DataFrame) -> DataFrame:
    """Adds parkinson_score: trend of the range volatility, expansion, place of the range among the symbol's ranges so far, lengths.

    The place counts all ranges up to the bar, so that the last bar's is its place in the whole history.
    """
    import math

    k = 1 / math.sqrt(4 * math.log(2))
    x = x.withColumns({"_p": F.when((col("high") > 0) & (col("low") > 0), k * F.abs(F.ln(col("high") / col("low")))), "_w": col("high") - col("low")})
    x = recursive.per_symbol(x, ["_k"], lambda p: {"_k": recursive.rank_so_far(p["_w"].to_numpy(float))})
    place = col("_k")
    lengths = sum((w * squash(_above("_p", n), 0.5) for n, w in list(PARKINSON.items())[1:]), PARKINSON[5] * squash(_above("_p", 5), 0.5))
    score = weighted([(0.35, squash(_above("_p", 21), 0.5)), (0.25, squash(_above("_w", 10), 0.5)), (0.2, (place - 0.5) * 2), (0.2, lengths)])
    return x.withColumn("parkinson_score", score).drop("_p", "_w", "_k")


#: Fixed value: bars over which the weight of a touch falls to 1 / e. Weights are whole multiples of 1e-12, so that sums are exact.
DECAY, UNIT = 100.0, 10**12


def levels(bars: DataFrame, bins: int = 1000, touches: int = 3, keep: int = 5) -> DataFrame:
    """Per symbol the strongest price bins (of 1 / bins of its range) that at least `touches` bars reach into.

    The strength is the number of touches times the sum of their weights, which fall with the bar's place in the
    history, exp(-place / DECAY), as in the rule that this follows. A bar gives two rows, one where its bins begin and one after
    they end; running sums over the bins, 1 / bins of the range each, give the counts.
    """
    ends = bars.groupBy("symbol").agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    x = bars.withColumn("_i", F.row_number().over(R.ordered()) - 1).join(ends.where("_hi > _lo"), "symbol")
    step = (F.col("_hi") - F.col("_lo")) / bins
    x = x.withColumns({"_a": F.floor((F.col("low") - F.col("_lo")) / step), "_b": F.ceil((F.col("high") - F.col("_lo")) / step), "_w": F.floor(F.exp(-F.col("_i") / DECAY) * UNIT)})
    x = x.where("_b > _a").select("symbol", F.inline(F.array(F.struct(F.col("_a").alias("bin"), F.lit(1).alias("n"), F.col("_w").alias("w")), F.struct(F.col("_b").alias("bin"), F.lit(-1).alias("n"), (-F.col("_w")).alias("w")))))
    x = x.groupBy("symbol", "bin").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    every = ends.where("_hi > _lo").select("symbol", "_lo", "_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    run = Window.partitionBy("symbol").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    g = every.join(x, ["symbol", "bin"], "left").select("symbol", "bin", "_lo", "_hi", F.sum(F.coalesce("n", F.lit(0))).over(run).alias("touches"), F.sum(F.coalesce("w", F.lit(0))).over(run).alias("_w"))
    g = g.where(F.col("touches") >= touches).withColumn("strength", F.col("touches") * F.col("_w") / UNIT)
    w = Window.partitionBy("symbol").orderBy(F.desc("strength"), "bin")
    g = g.withColumns({"rank": F.row_number().over(w), "price": F.col("_lo") + (F.col("bin") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins})
    return g.where(F.col("rank") <= keep).select("symbol", "rank", "bin", "price", "touches", "strength")


def level_signal(bars: DataFrame, found: DataFrame, near: float = 10.0, factor: float = 2.0) -> DataFrame:
    """Per symbol the pull of its levels on the last close: against the side that it is on, the more the nearer and the stronger."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    d = ratio(F.col("close") - F.col("price"), F.col("price"))
    x = last.join(found, "symbol", "left").groupBy("symbol").agg(F.sum(-F.signum(d) * F.exp(-F.abs(d) * near) * F.col("strength")).alias("_s"), F.sum("strength").alias("_t"))
    return x.select("symbol", F.coalesce(F.tanh(ratio(F.col("_s"), F.col("_t")) * factor), F.lit(0.0)).alias("level_signal"))


def trendline(x: DataFrame, n: int = 20, least: float = 1e-4, near: float = 0.02, test: float = 0.5, factor: float = 2.0) -> DataFrame:
    """Adds slopes of the rolling maximum and minimum of close over the bars so far, and trend_signal.

    The line's level is the last extreme plus the slope. A price within `near` of it tests it and counts `test` in the
    slope's direction; one beyond it counts 1, against the slope if above. A slope below `least` counts nothing.
    """
    w, so_far = R.ordered().rowsBetween(-n, 0), R.ordered().rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_h": F.max("close").over(w), "_l": F.min("close").over(w), "_n": F.row_number().over(R.ordered()).cast("double")})
    x = x.withColumns({"high_slope": F.coalesce(F.regr_slope("_h", "_n").over(so_far), F.lit(0.0)), "low_slope": F.coalesce(F.regr_slope("_l", "_n").over(so_far), F.lit(0.0))})

    def signal(level: str, slope: str) -> Column:
        d = ratio(col("close") - (col(level) + col(slope)), col(level) + col(slope))
        return F.when(F.abs(col(slope)) < least, 0.0).when(F.abs(d) < near, F.signum(slope) * test).otherwise(-F.signum(d) * F.signum(slope))

    return x.withColumn("trend_signal", F.tanh((signal("_h", "high_slope") + signal("_l", "low_slope")) * factor)).drop("_h", "_l", "_n")


def yang_zhang_score(x: DataFrame, k: float = 0.34) -> DataFrame:
    """Adds yang_zhang_score: trend of the estimator, overnight gaps, intraday ranges, its three parts against their means so far.

    Deviations and means run up to the bar, which at the last bar is the whole history.
    """
    ln = lambda a, b: F.when((a > 0) & (b > 0), F.ln(a / b))
    o, h, l, c, p = col("open"), col("high"), col("low"), col("close"), lag("close")
    x = x.withColumns({"_o": ln(o, p), "_c": ln(c, o), "_s": ln(h, c) * ln(h, o) + ln(l, c) * ln(l, o), "_g": ratio(o - p, p), "_i": ratio(h - l, o)})
    x = x.withColumns({"_vo": R.roll(F.var_samp, "_o", 21), "_vc": R.roll(F.var_samp, "_c", 21), "_vs": sma("_s", 21)})
    var = col("_vo") + k * col("_vc") + (1 - k) * col("_vs")
    x = x.withColumn("_y", F.when(var >= 0, F.sqrt(var)))
    gaps = ratio(R.std("_g", 5), R.running(F.stddev_samp, "_g"))
    part = lambda n: F.when(R.running(F.avg, n) == 0, 0.0).otherwise(ratio(col(n), R.running(F.avg, n)))
    parts = (part("_vo") + part("_vc") + part("_vs")) / 3 - 1
    score = weighted([(0.3, squash(_above("_y", 21), 0.5)), (0.25, squash(gaps - 1, 0.5)), (0.25, squash(_above("_i", 10), 0.5)), (0.2, squash(parts, 0.5))])
    return x.withColumn("yang_zhang_score", score).drop("_o", "_c", "_s", "_g", "_i", "_vo", "_vc", "_vs", "_y")


def blend(columns: dict[str, str]) -> Column:
    """The families' weighted sum, limited; columns: family -> column, for the families of BLEND."""
    return family(BLEND, columns)


# Weights of the volume patterns.
VOLUME = {"volume_trend": 0.30, "price_volume": 0.25, "volume_burst": 0.25, "accumulation": 0.20}


def _diverging(price: Column, other: Column, down: float, limit: float, scale: float) -> Column:
    """Where price moved by more than the limit and the other went the other way: twice the other, with `down` as its sign
    when price rose; else the squashed other."""
    return F.when(price.isNull() | other.isNull(), None).when((price < -limit) & (other > 0), other * 2).when((price > limit) & (other < 0), down * other * 2).otherwise(F.tanh(other * scale))


def volume_score(x: DataFrame) -> DataFrame:
    """Adds volume_trend, price_volume, volume_burst, accumulation and volume_score, their limited weighted sum.

    Trend: 5 over 20 bars of volume against price. Price-volume: correlation of their changes over 20 bars, negative is bullish,
    and the side of the mean product over 10. Burst: z-score of volume in the direction of 5 bars, against it
    above 3. Accumulation: 5 over 20 bars of the accumulation line against the price 19 bars before.
    """
    x = x.withColumns({"_pc": R.ret(), "_vc": R.ret("volume")})
    clv = ratio((col("close") - col("low")) - (col("high") - col("close")), col("high") - col("low"))
    x = x.withColumns({"_f": col("_pc") * col("_vc"), "_ad": F.sum(F.coalesce(clv, F.lit(0.0)) * col("volume")).over(R.ordered().rowsBetween(Window.unboundedPreceding, 0))})
    over = lambda c: F.when(sma(c, 20) == 0, 0.0).otherwise(ratio(sma(c, 5), sma(c, 20)) - 1)
    both, w = F.when(col("_pc").isNotNull() & col("_vc").isNotNull(), 1), R.frame(20)
    corr = F.when(F.count(both).over(w) == 20, F.corr("_pc", "_vc").over(w))
    dev, m = R.std("volume", 20), R.ret("close", 5)
    z = F.when(dev == 0, 0.0).otherwise(ratio(col("volume") - sma("volume", 20), dev))
    burst = F.when(z.isNull() | m.isNull(), None).when((F.abs(z) > 3) & (m > 0.02), -1.0).when((F.abs(z) > 3) & (m < -0.02), 1.0).otherwise(F.tanh(z * F.signum(m) * 1.5))
    x = x.withColumns({
        "volume_trend": _diverging(over("close"), over("volume"), -1.0, 0.02, 2.0), "price_volume": F.tanh((-corr + F.signum(sma("_f", 10))) * 2.0), "volume_burst": burst,
        "accumulation": _diverging(R.ret("close", 19), ratio(sma("_ad", 5), sma("_ad", 20)) - 1, 1.0, 0.02, 1.5),
    })
    return x.withColumn("volume_score", family(VOLUME, {c: c for c in VOLUME})).drop("_pc", "_vc", "_f", "_ad")
