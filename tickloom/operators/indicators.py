"""Indicators over a symbol's bars with window functions (W1-W57 but the recursive ones).

Builders return a dict of columns, to be used in one select so that all share a partitioning and sort.
Windows that aren't full give null; divisions by 0 give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.rolling import col, frame, highest, lag, log_ret, lowest, ordered, ratio, ret, roll, running, sma, std
from . import recursive

Columns = dict[str, Column]


def returns(periods: tuple[int, ...] = (1, 3, 5)) -> Columns:
    """Simple and log returns, the next bar's return and its direction."""
    nxt = ratio(F.lead("close").over(ordered()), col("close")) - 1
    return {f"ret_{n}": ret("close", n) for n in periods} | {"log_ret": log_ret(), "next_ret": nxt, "up": (nxt > 0).cast("int")}


def averages(lengths: tuple[int, ...] = (5, 10, 20, 50)) -> Columns:
    """Price averages."""
    return {f"sma_{n}": sma("close", n) for n in lengths}


def average_grid(start: int = 20, end: int = 80, step: int = 20) -> Columns:
    """Averages over close, and the differences of every pair of lengths."""
    ns = range(start, end + 1, step)
    rel = {n: ratio(sma("close", n), col("close")) for n in ns}
    return {f"sma_rel_{n}": c for n, c in rel.items()} | {f"sma_delta_{a}_{b}": rel[a] - rel[b] for a in ns for b in ns if a < b}


def rsi(n: int = 14) -> Column:
    """Relative strength from rolling means of gains and losses (needs with_gains); 100 without losses."""
    w = frame(n)
    g, l = F.avg("_gain").over(w), F.avg("_loss").over(w)
    ok = F.count("_gain").over(w) == n
    return F.when(ok & (l == 0) & (g > 0), 100.0).when(ok, 100 - 100 / (1 + ratio(g, l)))


def with_gains(bars: DataFrame) -> DataFrame:
    """Adds _gain and _loss, what rsi() averages."""
    x = bars.withColumn("_d", col("close") - lag("close"))
    return x.withColumns({"_gain": F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), "_loss": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))}).drop("_d")


def bollinger(n: int = 20, k: float = 2.0, population: bool = False) -> Columns:
    """Middle, upper and lower band, width over the middle, and place between the bands."""
    m, s = sma("close", n), std("close", n, population)
    return {"bb_mid": m, "bb_up": m + k * s, "bb_low": m - k * s, "bb_width": ratio(2 * k * s, m), "bb_pos": ratio(col("close") - m + k * s, 2 * k * s)}


def volatility(n: int = 20, per_year: float = 252.0) -> Columns:
    """Deviation of returns (needs column ret), annualised, and price deviation over close."""
    s = std("ret", n)
    return {"vol": s, "vol_year": s * math.sqrt(per_year), "vol_rel": ratio(std("close", n), col("close"))}


def momentum(n: int = 10) -> Columns:
    """Price z-score, mean return, price over its average, deviation of price."""
    return {"z": R.zscore("close", n), "mom": sma("ret", n), "rel_sma": ratio(col("close"), sma("close", n)), "price_std": std("close", n)}


def shape(n: int = 20) -> Columns:
    """Bias-corrected skewness and excess kurtosis of returns."""
    return {"skew": R.skewness("ret", n), "kurt": R.kurtosis("ret", n)}


def channel(n: int = 20) -> Columns:
    """Highest high and lowest low of n bars, middle, relative place, and breakout (+1, -1) of the previous channel."""
    hi, lo = highest("high", n), lowest("low", n)
    up, down = highest("high", n, end=-1), lowest("low", n, end=-1)
    return {
        "ch_high": hi, "ch_low": lo, "ch_mid": (hi + lo) / 2, "ch_pos": ratio(col("close") - lo, hi - lo),
        "ch_break": F.when(up.isNotNull(), F.when(col("close") > up, 1).when(col("close") < down, -1).otherwise(0)),
    }


def new_extremes(x: DataFrame, n: int = 20) -> DataFrame:
    """Share of the last n bars that made a new n-bar high, and low."""
    x = x.withColumns({"_nh": F.when(highest("close", n).isNotNull(), (col("close") >= highest("close", n)).cast("double")), "_nl": F.when(lowest("close", n).isNotNull(), (col("close") <= lowest("close", n)).cast("double"))})
    return x.withColumns({"new_high": roll(F.avg, "_nh", n), "new_low": roll(F.avg, "_nl", n)}).drop("_nh", "_nl")


def drawdown(c: str = "close") -> Columns:
    """Running maximum, and the fall from it as a fraction."""
    peak = running(F.max, c)
    return {"peak": peak, "drawdown": ratio(col(c), peak) - 1}


def growth(n: int = 10) -> Columns:
    """Compounded return since the start and over the last n bars (needs column ret)."""
    g = 1 + F.coalesce(col("ret"), F.lit(0.0))
    return {"cum_ret": running(F.product, g) - 1, "ret_over": F.when(F.count("ret").over(frame(n)) == n, F.product(g).over(frame(n)) - 1)}


def lags(columns: list[str], n: int) -> Columns:
    """The columns of the last n bars, <name>_t<k>."""
    return {f"{c}_t{k}": (col(c) if not k else lag(c, k)) for c in columns for k in range(n)}


def sequences(columns: list[str], n: int) -> Column:
    """The last n rows of the columns as an array of structs, null until there are n."""
    w = frame(n)
    return F.when(F.count("*").over(w) == n, F.collect_list(F.struct(*columns)).over(w))


def volume(n: int = 20) -> Columns:
    """Average volume, and volume over it (0 where that is 0)."""
    m = sma("volume", n)
    return {"vol_sma": m, "vol_ratio": F.when(m.isNotNull(), F.coalesce(ratio(col("volume"), m), F.lit(0.0)))}


def with_flow(bars: DataFrame) -> DataFrame:
    """Adds what the running volume lines sum: _obv (first bar: its volume) and _ad (0 where high = low)."""
    d = col("close") - lag("close")
    clv = ratio((col("close") - col("low")) - (col("high") - col("close")), col("high") - col("low"))
    return bars.withColumns({"_obv": F.when(d.isNull(), col("volume")).otherwise(F.signum(d) * col("volume")), "_ad": F.coalesce(clv, F.lit(0.0)) * col("volume")})


def volume_lines() -> Columns:
    """On-balance volume and the accumulation/distribution line (needs with_flow)."""
    return {"obv": running(F.sum, "_obv"), "ad": running(F.sum, "_ad")}


def line_ratio(line: str = "ad", short: int = 5, long: int = 20) -> Column:
    """Short average of a line over its long one."""
    return ratio(sma(line, short), sma(line, long))


def true_range() -> Column:
    """The largest of high - low and the distances of high and low from the last close."""
    p = lag("close")
    return F.greatest(col("high") - col("low"), F.abs(col("high") - p), F.abs(col("low") - p))


def atr_trend(atr: str = "atr", band: float = 0.1) -> Column:
    """Rising, falling or stable, by the 5-bar average of ATR against the 20-bar one."""
    a, b = sma(atr, 5), sma(atr, 20)
    return F.when(b.isNull(), None).when(a > b * (1 + band), "rising").when(a < b * (1 - band), "falling").otherwise("stable")


def ichimoku(a: int = 9, b: int = 26, c: int = 52) -> Columns:
    """Averages of the median price, the variant that the blueprint asks for."""
    m = (col("high") + col("low")) / 2
    tenkan, kijun = sma(m, a), sma(m, b)
    return {"tenkan": tenkan, "kijun": kijun, "senkou_a": (tenkan + kijun) / 2, "senkou_b": sma(m, c)}


def with_money(bars: DataFrame) -> DataFrame:
    """Adds _up and _down, the money flow of bars whose typical price rose or fell."""
    t = (col("high") + col("low") + col("close")) / 3
    x = bars.withColumn("_t", t).withColumn("_pt", lag("_t"))
    flow = col("_t") * col("volume")
    x = x.withColumns({"_up": F.when(col("_pt").isNotNull(), F.when(col("_t") > col("_pt"), flow).otherwise(0.0)), "_down": F.when(col("_pt").isNotNull(), F.when(col("_t") < col("_pt"), flow).otherwise(0.0))})
    return x.drop("_t", "_pt")


def mfi(n: int = 14) -> Column:
    """Money flow index (needs with_money); 100 without falling flow."""
    u, d = roll(F.sum, "_up", n), roll(F.sum, "_down", n)
    return F.when((d == 0) & (u > 0), 100.0).otherwise(100 - 100 / (1 + ratio(u, d)))


def williams(n: int = 14) -> Column:
    """Williams %R."""
    hi, lo = highest("high", n), lowest("low", n)
    return ratio(hi - col("close"), hi - lo) * -100


def aroon(n: int = 25) -> Columns:
    """Bars since the latest extreme of n + 1 bars, as a percentage (needs column seq, the bar's number)."""
    w = frame(n + 1)
    place = lambda c, sign: F.when(F.count(c).over(w) == n + 1, 100.0 * (n - (col("seq") - F.max_by("seq", F.struct(sign * F.col(c), F.col("seq"))).over(w))) / n)
    return {"aroon_up": place("high", 1), "aroon_down": place("low", -1)}


def cci(x: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index, with the mean absolute deviation from the window's own mean."""
    t = (col("high") + col("low") + col("close")) / 3
    x = x.withColumns({"_t": t, "_m": sma(t, n), "_w": F.collect_list(t).over(frame(n))})
    dev = F.aggregate("_w", F.lit(0.0), lambda a, v: a + F.abs(v - col("_m"))) / n
    return x.withColumn("cci", ratio(col("_t") - col("_m"), 0.015 * dev)).drop("_t", "_m", "_w")


def with_ranges(bars: DataFrame) -> DataFrame:
    """Adds the logs of a bar's prices that the range estimators use; null unless prices are positive."""
    ln = lambda a, b: F.when((col(a) > 0) & (col(b) > 0), F.ln(col(a) / col(b)))
    x = bars.withColumn("_pc", lag("close"))
    return x.withColumns({"_hl": ln("high", "low"), "_ho": ln("high", "open"), "_hc": ln("high", "close"), "_lo": ln("low", "open"), "_lc": ln("low", "close"), "_co": ln("close", "open"), "_on": ln("open", "_pc")}).drop("_pc")


def range_volatility(n: int = 21, k: float = 0.34) -> Columns:
    """Parkinson (bar and rolling ratio), Garman-Klass, Rogers-Satchell and Yang-Zhang (needs with_ranges)."""
    park = F.sqrt(F.pow("_hl", F.lit(2)) / (4 * math.log(2)))
    gk = 0.5 * F.pow("_hl", F.lit(2)) - (2 * math.log(2) - 1) * F.pow("_co", F.lit(2))
    rs = col("_hc") * col("_ho") + col("_lc") * col("_lo")
    yz = roll(F.var_samp, "_on", n) + k * roll(F.var_samp, "_co", n) + (1 - k) * roll(F.avg, rs, n)
    return {"parkinson": park, "parkinson_ratio": ratio(park, roll(F.avg, park, n)), "garman_klass": gk, "rogers_satchell": rs, "yang_zhang": F.when(yz >= 0, F.sqrt(yz))}


def autocorrelation(k: int = 1, n: int = 60) -> Column:
    """Correlation of the last n returns with those k bars before (needs column ret and ret_lag)."""
    w = frame(n)
    both = F.when(col("ret").isNotNull() & col("ret_lag").isNotNull(), 1)
    return F.when(F.count(both).over(w) == n, F.corr("ret", "ret_lag").over(w))


def trend_slope(c: str = "close", n: int = 20) -> Column:
    """Least-squares slope of the last n values over their place (needs column seq)."""
    w = frame(n)
    return F.when(F.count(c).over(w) == n, F.regr_slope(c, F.col("seq").cast("double")).over(w))


def term_slope(x: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """Slope of annualised volatility over window length; vol_<n> must be there."""
    xs = [float(n) for n in windows]
    m = sum(xs) / len(xs)
    den = sum((v - m) ** 2 for v in xs)
    return x.withColumn("term_slope", sum((v - m) * F.col(f"vol_{n}") for v, n in zip(xs, windows, strict=True)) / den)


def range_rank(bars: DataFrame) -> DataFrame:
    """range_rel, and range_rank: the share of a symbol's bars up to this one whose relative range is no larger.

    Bars without a range (close 0) count in neither part and have no rank. One grouped pass, n log n for a symbol.
    """
    x = bars.withColumn("range_rel", ratio(col("high") - col("low"), col("close")))
    return recursive.per_symbol(x, ["range_rank"], lambda p: {"range_rank": recursive.rank_so_far(p["range_rel"].to_numpy(float))})


PAIR = ("sym1", "sym2")


def rolling_pair(n: int = 60, at_least: int = 1) -> Columns:
    """Correlation, covariance and beta of ret1 and ret2 of a pair over the last n rows; beta is 0 if var is tiny."""
    w = frame(n, PAIR)
    ok = F.count(F.when(col("ret1").isNotNull() & col("ret2").isNotNull(), 1)).over(w) >= max(at_least, 2)
    cov, var = F.covar_samp("ret1", "ret2").over(w), F.var_samp(F.when(col("ret1").isNotNull(), col("ret2"))).over(w)
    return {"corr": F.when(ok, F.corr("ret1", "ret2").over(w)), "cov": F.when(ok, cov), "beta": F.when(ok, F.when(var > 1e-8, cov / var).otherwise(0.0))}


def cross_section(c: str) -> Columns:
    """Mean and sample deviation over all symbols at a time."""
    w = Window.partitionBy("ts")
    return {f"mkt_{c}_mean": F.avg(c).over(w), f"mkt_{c}_std": F.stddev_samp(c).over(w)}


def force(x: DataFrame, n: int = 13) -> DataFrame:
    """Average force index, and the correlation of price and volume over n bars, NaN where one of them is the same in all."""
    x = x.withColumn("_f", (col("close") - lag("close")) * col("volume"))
    w = frame(n)
    return x.withColumns({"force": roll(F.avg, "_f", n), "pv_corr": F.when(F.count("close").over(w) == n, R.corr("close", "volume", w))}).drop("_f")


def volume_breakout(n: int = 20, high: float = 2.0, climax: float = 3.0) -> Columns:
    """Volume z-score and its signal: with the bar's direction above `high`, against it above `climax`."""
    z = R.zscore("volume", n)
    side = F.signum(col("close") - col("open"))
    return {"vol_z": z, "vol_break": F.when(z.isNull(), None).when(z > climax, -side).when(z > high, side).otherwise(0.0)}


def peaks(w: int = 3, c: str = "close") -> Columns:
    """Strictly above (below) the w bars on each side. Looks w bars ahead."""
    before, after = ordered().rowsBetween(-w, -1), ordered().rowsBetween(1, w)
    ok = (F.count(c).over(before) == w) & (F.count(c).over(after) == w)
    return {"is_peak": ok & (col(c) > F.max(c).over(before)) & (col(c) > F.max(c).over(after)), "is_trough": ok & (col(c) < F.min(c).over(before)) & (col(c) < F.min(c).over(after))}


def swings(w: int = 3, jump: float = 0.01, c: str = "close") -> Columns:
    """Peaks and troughs that also moved by `jump` against the last bar."""
    p, step = peaks(w, c), F.abs(ret(c))
    return {"swing_high": p["is_peak"] & F.coalesce(step >= jump, F.lit(False)), "swing_low": p["is_trough"] & F.coalesce(step >= jump, F.lit(False))}


def percent_rank(c: str) -> Column:
    """Rank among the symbols at a time, ties averaged, over their number."""
    by = Window.partitionBy("ts").orderBy(c)
    ties = F.count("*").over(Window.partitionBy("ts", c))
    return (F.rank().over(by) + (ties - 1) / 2) / F.count("*").over(Window.partitionBy("ts"))


def benchmark_return(x: DataFrame, scale: float = 1e6) -> DataFrame:
    """Volume-weighted return of all symbols at a time."""
    return x.where("ret is not null").groupBy("ts").agg((ratio(F.sum(F.col("ret") * F.col("volume")), F.sum("volume")) * scale).alias("benchmark"))


def beta_to(x: DataFrame, benchmark: DataFrame, n: int = 30) -> DataFrame:
    """Covariance with the benchmark over its variance, n bars; the left side keeps all bars."""
    x = x.join(benchmark, "ts", "left")
    w = frame(n)
    both = F.when(F.col("ret").isNotNull() & F.col("benchmark").isNotNull(), 1)
    return x.withColumn("beta", F.when(F.count(both).over(w) == n, ratio(F.covar_samp("ret", "benchmark").over(w), F.var_samp("benchmark").over(w))))


def downside(n: int = 10) -> Columns:
    """Share of down bars, up over down volatility, and the sum of signs of price against three averages (needs ret)."""
    down = F.when(F.col("ret").isNotNull(), (F.col("ret") < 0).cast("double"))
    w = frame(n)
    up_s, down_s = F.stddev_samp(F.when(col("ret") > 0, col("ret"))).over(w), F.stddev_samp(F.when(col("ret") < 0, col("ret"))).over(w)
    align = sum((F.signum(col("close") - sma("close", m)) for m in (5, 10, 20)), F.lit(0.0))
    return {"down_share": roll(F.avg, down, n), "updown": F.when(F.count("ret").over(w) == n, ratio(up_s, down_s)), "trend_align": align}


def three_way(n: int = 48, dead: float = 0.004) -> Column:
    """1, 0 or -1 for the return of the next n bars with a dead zone."""
    f = ratio(F.lead("close", n).over(ordered()), col("close")) - 1
    return F.when(f.isNull(), None).when(f > dead, 1).when(f < -dead, -1).otherwise(0)


def ideal_weights(x: DataFrame) -> DataFrame:
    """Weights in proportion to what the next return exceeds the mean of all symbols by; equal if none does."""
    w = Window.partitionBy("ts")
    x = x.withColumn("_n", ratio(F.lead("close").over(ordered()), col("close")) - 1).where("_n is not null")
    x = x.withColumn("_e", F.greatest(col("_n") - F.avg("_n").over(w), F.lit(0.0)))
    return x.withColumn("weight", F.coalesce(ratio(col("_e"), F.sum("_e").over(w)), 1 / F.count("*").over(w))).drop("_n", "_e")


def regime_features(bars: DataFrame) -> DataFrame:
    """Price against three averages, crosses, rates of change, volatility ratios, range place, extremes, drawdown, momentum state."""
    x = bars.withColumn("ret", ret())
    a, b, c = sma("close", 21), sma("close", 50), sma("close", 200)
    x = x.select(
        "symbol", "ts", "close", "ret",
        ratio(col("close"), a).alias("p_21"), ratio(col("close"), b).alias("p_50"), ratio(col("close"), c).alias("p_200"),
        ratio(a, b).alias("cross_21_50"), ratio(b, c).alias("cross_50_200"),
        *(ret("close", n).alias(f"roc_{n}") for n in (10, 21, 63)),
        std("ret", 10).alias("v_10"), std("ret", 21).alias("v_21"), std("ret", 63).alias("v_63"),
        ratio(col("close") - lowest("close", 50), highest("close", 50) - lowest("close", 50)).alias("range_pos"),
        drawdown()["drawdown"].alias("drawdown"),
    )
    x = new_extremes(x, 21)
    return x.withColumns({
        "v_ratio": ratio(col("v_10"), col("v_63")),
        "nvts": ratio(col("roc_21"), col("v_21")),
        "mom_state": F.when(col("roc_21").isNull() | col("roc_63").isNull(), None).when((col("roc_21") > 0) & (col("roc_63") > 0), 1).when((col("roc_21") < 0) & (col("roc_63") < 0), -1).otherwise(0),
    })
