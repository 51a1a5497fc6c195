"""Registered queries on windowed indicators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import rolling as R
from ..operators import align, pairs
from ..operators import indicators as I

from .sql import CENTS, HOURLY, PAIRS, lag, over, roll, rounded, select, so_far

QUERIES, ORACLES = {}, {}


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = text
        return f

    return add


def _seq(s, d):
    from pyspark.sql import Window

    return schema.bars(s, d).withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))


def _ret(s, d):
    return _seq(s, d).withColumn("ret", R.ret())


def _pick(x, cols):
    return rounded(x.select("symbol", "ts", *(c.alias(n) for n, c in cols.items())))


K = "symbol, ts"
NEXT = "lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1"


@query(
    f"WITH {HOURLY}, x AS (SELECT *, {NEXT} AS nx, close / nullif({lag('close')}, 0) AS q FROM bars) SELECT {K}, "
    + ", ".join(f"round(close / nullif({lag('close', n)}, 0) - 1, 6) + 0.0::DOUBLE AS ret_{n}" for n in (1, 3, 5))
    + ", round(CASE WHEN q > 0 THEN ln(q) END, 6) + 0.0::DOUBLE AS log_ret, round(nx, 6) + 0.0::DOUBLE AS next_ret, (nx > 0)::INT AS up FROM x"
)
def w01_w04_returns(s, d):
    return _pick(schema.bars(s, d), I.returns())


@query(select(HOURLY, "bars", K, **{f"sma_{n}": roll("avg", "close", n) for n in (5, 10, 20, 50)}))
def w05_averages(s, d):
    return _pick(schema.bars(s, d), I.averages())


_REL = {n: f"({roll('avg', 'close', n)} / nullif(close, 0))" for n in (20, 40, 60, 80)}


#: Sums of whole cents are exact, so these ratios are compared to the last bit: rounding would differ on exact halves.
_GRID = {f"sma_rel_{n}": e for n, e in _REL.items()} | {f"sma_delta_{a}_{b}": f"{_REL[a]} - {_REL[b]}" for a in _REL for b in _REL if a < b}


@query(f"WITH {CENTS} SELECT {K}, {', '.join(f'{e} AS {n}' for n, e in _GRID.items())} FROM bars")
def w06_average_grid(s, d):
    return schema.in_cents(schema.bars(s, d)).select("symbol", "ts", *(c.alias(n) for n, c in I.average_grid().items()))


_GL = HOURLY + f", gl AS (SELECT symbol, ts, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM (SELECT *, close - {lag('close')} AS d FROM bars)), gm AS (SELECT symbol, ts, {roll('avg', 'CASE WHEN g IS NOT NULL THEN g END', 14)} AS g, {roll('avg', 'l', 14)} AS l FROM (SELECT symbol, ts, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS l FROM (SELECT *, close - {lag('close')} AS d FROM bars)))"


@query(select(_GL, "gm", K, rsi="CASE WHEN l = 0 AND g > 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END"))
def w10_rsi(s, d):
    return _pick(I.with_gains(schema.bars(s, d)), {"rsi": I.rsi(14)})


_M, _S = roll("avg", "close", 20), roll("stddev_samp", "close", 20)


@query(select(HOURLY, "bars", K, 5, bb_mid=_M, bb_up=f"{_M} + 2 * {_S}", bb_low=f"{_M} - 2 * {_S}", bb_width=f"4 * {_S} / nullif({_M}, 0)", bb_pos=f"(close - {_M} + 2 * {_S}) / nullif(4 * {_S}, 0)"))
def w13_bollinger(s, d):
    x = schema.bars(s, d)
    return rounded(x.select("symbol", "ts", *(c.alias(n) for n, c in I.bollinger().items())), 5)


_R = HOURLY + ", rr AS (SELECT * FROM rets)"


@query(select(_R, "rr", K, 4, vol=roll("stddev_samp", "ret", 20), vol_year=f"{roll('stddev_samp', 'ret', 20)} * sqrt(252)", vol_rel=f"{_S} / nullif(close, 0)", z=f"(close - {roll('avg', 'close', 10)}) / nullif({roll('stddev_samp', 'close', 10)}, 0)", mom=roll("avg", "ret", 10), rel_sma=f"close / nullif({roll('avg', 'close', 10)}, 0)", price_std=roll("stddev_samp", "close", 10)))
def w14_w16_volatility_momentum(s, d):
    x = _ret(s, d)
    return rounded(x.select("symbol", "ts", *(c.alias(n) for n, c in (I.volatility() | I.momentum()).items())), 4)


@query(select(_R + f", lr AS (SELECT *, ln(nullif(close, 0) / nullif({lag('close')}, 0)) AS l FROM rets)", "lr", K, 4, skew=roll("skewness", "l", 20), kurt=roll("kurtosis", "l", 20)))
def w17_shape(s, d):
    x = schema.bars(s, d).withColumn("ret", R.log_ret())
    return rounded(x.select("symbol", "ts", *(c.alias(n) for n, c in I.shape().items())), 4)


_HI, _LO = roll("max", "high", 20), roll("min", "low", 20)


@query(
    select(HOURLY, f"(SELECT *, {_HI} AS hi, {_LO} AS lo, {roll('max', 'high', 20, end=-1)} AS u, {roll('min', 'low', 20, end=-1)} AS v FROM bars)", K + ", CASE WHEN u IS NULL THEN NULL WHEN close > u THEN 1 WHEN close < v THEN -1 ELSE 0 END AS ch_break", ch_high="hi", ch_low="lo", ch_mid="(hi + lo) / 2", ch_pos="(close - lo) / nullif(hi - lo, 0)")
)
def w18_channel(s, d):
    return _pick(schema.bars(s, d), I.channel())


@query(select(HOURLY + f", e AS (SELECT symbol, ts, CASE WHEN {roll('max', 'close', 20)} IS NOT NULL THEN (close >= {roll('max', 'close', 20)})::DOUBLE END AS h, CASE WHEN {roll('min', 'close', 20)} IS NOT NULL THEN (close <= {roll('min', 'close', 20)})::DOUBLE END AS l FROM bars)", "e", K, new_high=roll("avg", "h", 20), new_low=roll("avg", "l", 20)))
def w19_new_extremes(s, d):
    return rounded(I.new_extremes(schema.bars(s, d)).select("symbol", "ts", "new_high", "new_low"))


@query(select(HOURLY, "bars", K, peak=so_far("max", "close"), drawdown=f"close / nullif({so_far('max', 'close')}, 0) - 1"))
def w20_drawdown(s, d):
    return _pick(schema.bars(s, d), I.drawdown())


@query(select(HOURLY + f", g AS (SELECT symbol, ts, log(1 + v) AS g, v FROM (SELECT symbol, ts, (n - 10) / 1000.0::DOUBLE AS v FROM bars))", "g", K, cum_ret=f"pow(10, {so_far('sum', 'g')}) - 1", ret_over=f"pow(10, {roll('sum', 'g', 10)}) - 1"))
def w21_growth(s, d):
    x = schema.bars(s, d).withColumn("ret", (F.col("n") - 10) / 1000.0)
    return _pick(x, I.growth(10))


@query(f"WITH {HOURLY} SELECT {K}, " + ", ".join(f"{lag(c, k) if k else c} AS {c}_t{k}" for c in ("open", "close") for k in range(3)) + " FROM bars")
def w22_lags(s, d):
    return _pick(schema.bars(s, d), I.lags(["open", "close"], 3))


@query(f"WITH {HOURLY}, w AS (SELECT symbol, ts, CASE WHEN count(*) {over(6)} = 6 THEN list(close) {over(6)} END AS a FROM bars) SELECT symbol, ts, len(a)::INT AS n, round(list_sum(a), 4) AS total, a[1] AS first, a[6] AS last FROM w WHERE a IS NOT NULL")
def w23_sequences(s, d):
    x = schema.bars(s, d).select("symbol", "ts", I.sequences(["close"], 6).alias("a")).where("a is not null")
    return x.select("symbol", "ts", F.size("a").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda t, v: t + v["close"]), 4).alias("total"), F.get("a", F.lit(0))["close"].alias("first"), F.get("a", F.lit(5))["close"].alias("last"))


_VM = roll("avg", "volume", 20)


@query(select(HOURLY, "bars", K, vol_sma=_VM, vol_ratio=f"CASE WHEN {_VM} IS NOT NULL THEN coalesce(volume / nullif({_VM}, 0), 0) END"))
def w24_volume(s, d):
    return _pick(schema.bars(s, d), I.volume())


_FL = HOURLY + f", fl AS (SELECT symbol, ts, CASE WHEN dd IS NULL THEN volume ELSE sign(dd) * volume END AS o, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS a FROM (SELECT *, close - {lag('close')} AS dd FROM bars)), lines AS (SELECT symbol, ts, {so_far('sum', 'o')} AS obv, {so_far('sum', 'a')} AS ad FROM fl)"


@query(select(_FL, "lines", K, 5, obv="obv", ad="ad", ad_avg=roll("avg", "ad", 5)))
def w25_w26_volume_lines(s, d):
    x = I.with_flow(schema.bars(s, d)).select("symbol", "ts", *(c.alias(n) for n, c in I.volume_lines().items()))
    return rounded(x.select("symbol", "ts", "obv", "ad", R.sma("ad", 5).alias("ad_avg")), 5)


_TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


@query(
    select(HOURLY + f", tr AS (SELECT symbol, ts, {_TR} AS tr FROM bars), a AS (SELECT *, {roll('avg', 'tr', 5)} AS a, {roll('avg', 'tr', 20)} AS b FROM tr)", "a", K + ", CASE WHEN b IS NULL THEN NULL WHEN a > b * (1 + 0.1::DOUBLE) THEN 'rising' WHEN a < b * (1 - 0.1::DOUBLE) THEN 'falling' ELSE 'stable' END AS trend", tr="tr")
)
def w27_w28_true_range(s, d):
    x = schema.bars(s, d).withColumn("tr", I.true_range())
    return rounded(x.select("symbol", "ts", "tr", I.atr_trend("tr").alias("trend")))


_MP = "((high + low) / 2)"


@query(select(HOURLY, "bars", K, tenkan=roll("avg", _MP, 9), kijun=roll("avg", _MP, 26), senkou_a=f"({roll('avg', _MP, 9)} + {roll('avg', _MP, 26)}) / 2", senkou_b=roll("avg", _MP, 52)))
def w31_ichimoku(s, d):
    return _pick(schema.bars(s, d), I.ichimoku())


_MF = HOURLY + f", tp AS (SELECT *, (high + low + close) / 3 AS t FROM bars), mf AS (SELECT symbol, ts, CASE WHEN p IS NOT NULL THEN CASE WHEN t > p THEN t * volume ELSE 0 END END AS u, CASE WHEN p IS NOT NULL THEN CASE WHEN t < p THEN t * volume ELSE 0 END END AS d FROM (SELECT *, {lag('t')} AS p FROM tp)), ms AS (SELECT symbol, ts, {roll('sum', 'u', 14)} AS u, {roll('sum', 'd', 14)} AS d FROM mf)"


@query(select(_MF, "ms", K, mfi="CASE WHEN d = 0 AND u > 0 THEN 100 ELSE 100 - 100 / (1 + u / nullif(d, 0)) END"))
def w33_money_flow(s, d):
    return _pick(I.with_money(schema.bars(s, d)), {"mfi": I.mfi(14)})


@query(select(HOURLY, "bars", K, **{f"willr_{n}": f"({roll('max', 'high', n)} - close) / nullif({roll('max', 'high', n)} - {roll('min', 'low', n)}, 0) * -100" for n in (14, 28, 42)}))
def w34_williams(s, d):
    return _pick(schema.bars(s, d), {f"willr_{n}": I.williams(n) for n in (14, 28, 42)})


@query(
    select(HOURLY + f", tp AS (SELECT *, (high + low + close) / 3 AS t FROM seqs), c AS (SELECT *, {roll('avg', 't', 20)} AS m, list(t) {over(20)} AS w, count(*) {over(26)} AS k, list(high) {over(26)} AS hs, list(low) {over(26)} AS ls FROM tp)", "c", K, 5, aroon_up="CASE WHEN k = 26 THEN 100.0 * (25 - (26 - (26 - list_position(list_reverse(hs), list_max(hs)) + 1))) / 25 END", aroon_down="CASE WHEN k = 26 THEN 100.0 * (25 - (26 - (26 - list_position(list_reverse(ls), list_min(ls)) + 1))) / 25 END", cci="CASE WHEN m IS NOT NULL THEN (t - m) / nullif(0.015 * list_sum([abs(v - m) for v in w]) / 20, 0) END")
)
def w35_aroon_cci(s, d):
    x = I.cci(_seq(s, d), 20)
    return rounded(x.select("symbol", "ts", "cci", *(c.alias(n) for n, c in I.aroon(25).items())), 5)


def _ln(a, b):
    return f"(CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END)"


_RG = HOURLY + f", rg AS (SELECT symbol, ts, {_ln('high', 'low')} AS hl, {_ln('high', 'open')} AS ho, {_ln('high', 'close')} AS hc, {_ln('low', 'open')} AS lo, {_ln('low', 'close')} AS lc, {_ln('close', 'open')} AS co, {_ln('open', 'pc')} AS o FROM (SELECT *, {lag('close')} AS pc FROM bars)), rv AS (SELECT *, sqrt(hl * hl / (4 * ln(2))) AS park, hc * ho + lc * lo AS rs FROM rg), ry AS (SELECT *, {roll('var_samp', 'o', 21)} + 0.34 * {roll('var_samp', 'co', 21)} + 0.66 * {roll('avg', 'rs', 21)} AS yz FROM rv)"


@query(select(_RG, "ry", K, 5, parkinson="park", parkinson_ratio=f"park / nullif({roll('avg', 'park', 21)}, 0)", garman_klass="0.5 * hl * hl - (2 * ln(2) - 1) * co * co", rogers_satchell="rs", yang_zhang="CASE WHEN yz >= 0 THEN sqrt(yz) END"))
def w36_w38_range_volatility(s, d):
    x = I.with_ranges(schema.bars(s, d))
    return rounded(x.select("symbol", "ts", *(c.alias(n) for n, c in I.range_volatility().items())), 5)


@query(
    select(HOURLY + f", ac AS (SELECT *, {lag('ret', 2)} AS rl FROM rets)", "ac", K, 5, autocorr=f"CASE WHEN count(CASE WHEN ret IS NOT NULL AND rl IS NOT NULL THEN 1 END) {over(60)} = 60 THEN corr(ret, rl) {over(60)} END", slope=f"CASE WHEN count(close) {over(20)} = 20 THEN regr_slope(close, seq) {over(20)} END", term="(" + " + ".join(f"({n} - 21.25) * {roll('stddev_samp', 'ret', n)}" for n in (5, 10, 20, 50)) + ") / " + str(sum((n - 21.25) ** 2 for n in (5, 10, 20, 50))))
)
def w40_autocorrelation_slopes(s, d):
    x = _ret(s, d).withColumn("ret_lag", R.lag("ret", 2))
    x = x.select("symbol", "ts", I.autocorrelation(2, 60).alias("autocorr"), I.trend_slope().alias("slope"), *(R.std("ret", n).alias(f"vol_{n}") for n in (5, 10, 20, 50)))
    return rounded(I.term_slope(x).select("symbol", "ts", "autocorr", "slope", F.col("term_slope").alias("term")), 5)


@query(select(HOURLY + ", r AS (SELECT symbol, ts, (high - low) / nullif(close, 0) AS r FROM bars), l AS (SELECT *, list(r) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM r)", "l", K, range_rel="r", range_rank="CASE WHEN r IS NOT NULL THEN len(list_filter(l, lambda v: v <= r)) / len(list_filter(l, lambda v: v IS NOT NULL)) END"))
def w41_range_rank(s, d):
    return rounded(I.range_rank(schema.bars(s, d)).select("symbol", "ts", "range_rel", "range_rank"))


_PW = over(60, "sym1, sym2")
_BOTH = f"count(CASE WHEN ret1 IS NOT NULL AND ret2 IS NOT NULL THEN 1 END) {_PW} >= 2"
_CV, _VR = f"covar_samp(ret1, ret2) {_PW}", f"var_samp(CASE WHEN ret1 IS NOT NULL THEN ret2 END) {_PW}"


@query(select(PAIRS, "pr", "sym1, sym2, ts", 4, corr=f"CASE WHEN {_BOTH} THEN corr(ret1, ret2) {_PW} END", cov=f"CASE WHEN {_BOTH} THEN {_CV} END", beta=f"CASE WHEN {_BOTH} THEN CASE WHEN {_VR} > 1e-8 THEN {_CV} / {_VR} ELSE 0 END END"))
def w42_rolling_pair(s, d):
    x = pairs.pair_returns(align.pair_bars(schema.bars(s, d)))
    return rounded(x.select("sym1", "sym2", "ts", *(c.alias(n) for n, c in I.rolling_pair().items())), 4)


@query(select(HOURLY, "bars", K, mkt_close_mean="avg(close) OVER (PARTITION BY ts)", mkt_close_std="stddev_samp(close) OVER (PARTITION BY ts)"))
def w43_cross_section(s, d):
    return _pick(schema.bars(s, d), I.cross_section("close"))


@query(select(HOURLY + f", f AS (SELECT *, (close - {lag('close')}) * volume AS f FROM bars)", "f", K, 5, force=roll("avg", "f", 13), pv_corr=f"CASE WHEN count(close) {over(13)} = 13 THEN corr(close, volume) {over(13)} END"))
def w45_force(s, d):
    return rounded(I.force(schema.bars(s, d)).select("symbol", "ts", "force", "pv_corr"), 5)


_VZ = f"(volume - {roll('avg', 'volume', 20)}) / nullif({roll('stddev_samp', 'volume', 20)}, 0)"


@query(select(HOURLY, f"(SELECT *, {_VZ} AS z FROM bars)", K, vol_z="z", vol_break="CASE WHEN z IS NULL THEN NULL WHEN z > 3 THEN -sign(close - open) WHEN z > 2 THEN sign(close - open) ELSE 0 END"))
def w46_volume_breakout(s, d):
    return _pick(schema.bars(s, d), I.volume_breakout())


_BE, _AF = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
_PK = HOURLY + f", pk AS (SELECT *, count(close) {_BE} = 3 AND count(close) {_AF} = 3 AS ok, max(close) {_BE} AS b1, max(close) {_AF} AS a1, min(close) {_BE} AS b2, min(close) {_AF} AS a2, abs(close / nullif({lag('close')}, 0) - 1) >= 0.01 AS j FROM bars)"
_P, _T = "coalesce(ok AND close > b1 AND close > a1, false)", "coalesce(ok AND close < b2 AND close < a2, false)"


@query(f"WITH {_PK} SELECT {K}, {_P} AS is_peak, {_T} AS is_trough, {_P} AND coalesce(j, false) AS swing_high, {_T} AND coalesce(j, false) AS swing_low FROM pk")
def w47_w48_peaks_swings(s, d):
    cols = I.peaks() | I.swings()
    return schema.bars(s, d).select("symbol", "ts", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in cols.items()))


_N9 = {n: roll("avg", "close", n) for n in (21, 50, 200)}
_X9 = CENTS + f", x AS (SELECT *, {', '.join(f'close / nullif({lag("close", n)}, 0) - 1 AS roc_{n}' for n in (10, 21, 63))}, {', '.join(f'{roll("stddev_samp", "ret", n)} AS v_{n}' for n in (10, 21, 63))}, CASE WHEN {roll('max', 'close', 21)} IS NOT NULL THEN (close >= {roll('max', 'close', 21)})::DOUBLE END AS h, CASE WHEN {roll('min', 'close', 21)} IS NOT NULL THEN (close <= {roll('min', 'close', 21)})::DOUBLE END AS l FROM rets)"


_EXACT = {f"p_{n}": f"close / nullif({e}, 0)" for n, e in _N9.items()} | {f"roc_{n}": f"roc_{n}" for n in (10, 21, 63)} | {
    "cross_21_50": f"{_N9[21]} / nullif({_N9[50]}, 0)", "cross_50_200": f"{_N9[50]} / nullif({_N9[200]}, 0)", "drawdown": f"close / nullif({so_far('max', 'close')}, 0) - 1",
    "range_pos": f"(close - {roll('min', 'close', 50)}) / nullif({roll('max', 'close', 50)} - {roll('min', 'close', 50)}, 0)",
    "mom_state": "CASE WHEN roc_21 IS NULL OR roc_63 IS NULL THEN NULL WHEN roc_21 > 0 AND roc_63 > 0 THEN 1 WHEN roc_21 < 0 AND roc_63 < 0 THEN -1 ELSE 0 END",
}


@query(select(_X9, "x", K + "".join(f", {e} AS {n}" for n, e in _EXACT.items()), 4, **{f"v_{n}": f"v_{n}" for n in (10, 21, 63)}, new_high=roll("avg", "h", 21), new_low=roll("avg", "l", 21), v_ratio="v_10 / nullif(v_63, 0)", nvts="roc_21 / nullif(v_21, 0)"))
def w49_regime_features(s, d):
    x = I.regime_features(schema.in_cents(schema.bars(s, d))).drop("close", "ret")
    return x.withColumns({c: F.round(c, 4) + 0.0 for c in ("v_10", "v_21", "v_63", "new_high", "new_low", "v_ratio", "nvts")})


@query(select(HOURLY, "bars", K, rank="(rank() OVER (PARTITION BY ts ORDER BY close) + (count(*) OVER (PARTITION BY ts, close) - 1) / 2) / count(*) OVER (PARTITION BY ts)"))
def w52_percent_rank(s, d):
    return _pick(schema.bars(s, d), {"rank": I.percent_rank("close")})


_BM = HOURLY + ", bm AS (SELECT ts, sum(ret * volume) / nullif(sum(volume), 0) AS b FROM rets WHERE ret IS NOT NULL GROUP BY ts), rb AS (SELECT rets.*, bm.b FROM rets LEFT JOIN bm USING (ts))"


@query(select(_BM, "rb", K, 4, benchmark="b", beta=f"CASE WHEN count(CASE WHEN ret IS NOT NULL AND b IS NOT NULL THEN 1 END) {over(30)} = 30 THEN covar_samp(ret, b) {over(30)} / nullif(var_samp(b) {over(30)}, 0) END"))
def w53_w54_benchmark_beta(s, d):
    x = _ret(s, d)
    return rounded(I.beta_to(x, I.benchmark_return(x, 1.0), 30).select("symbol", "ts", "benchmark", "beta"), 4)


@query(select(HOURLY, "rets", K, 5, down_share=roll("avg", "CASE WHEN ret IS NOT NULL THEN (ret < 0)::DOUBLE END", 10), updown=f"CASE WHEN count(ret) {over(10)} = 10 THEN stddev_samp(CASE WHEN ret > 0 THEN ret END) {over(10)} / nullif(stddev_samp(CASE WHEN ret < 0 THEN ret END) {over(10)}, 0) END", trend_align=" + ".join(f"sign(close - {roll('avg', 'close', n)})" for n in (5, 10, 20))))
def w55_downside(s, d):
    x = _ret(s, d)
    return rounded(x.select("symbol", "ts", *(c.alias(n) for n, c in I.downside().items())), 5)


@query(f"WITH {HOURLY}, f AS (SELECT *, lead(close, 48) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS f FROM bars) SELECT {K}, CASE WHEN f IS NULL THEN NULL WHEN f > 0.004 THEN 1 WHEN f < -0.004 THEN -1 ELSE 0 END AS label FROM f")
def w56_three_way(s, d):
    return schema.bars(s, d).select("symbol", "ts", I.three_way().alias("label"))


@query(select(HOURLY + f", nx AS (SELECT *, {NEXT} AS nr FROM bars), e AS (SELECT *, greatest(nr - avg(nr) OVER (PARTITION BY ts), 0) AS e FROM nx WHERE nr IS NOT NULL)", "e", K, weight="coalesce(e / nullif(sum(e) OVER (PARTITION BY ts), 0), 1.0 / count(*) OVER (PARTITION BY ts))"))
def w57_ideal_weights(s, d):
    return rounded(I.ideal_weights(schema.bars(s, d)).select("symbol", "ts", "weight"))


