"""Registered queries on scores and candle shapes; scores of recursive indicators have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import rolling as R
from ..operators import indicators as I
from ..operators import candles, patterns, recursive, scores
from .sql import CENTS, HOURLY, lag, over, roll, rounded, select

QUERIES, ORACLES = {}, {}


def query(text=None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


def _b(s, d):
    return schema.bars(s, d)


def cl(e):
    return f"greatest(least({e}, 1), -1)"


def ch(c, d):
    return f"(({c} - {lag(c, d - 1)}) / nullif({lag(c, d - 1)}, 0))"


K = "symbol, ts"
_C = HOURLY + f", m AS (SELECT *, {roll('avg', 'close', 20)} AS s, {roll('avg', 'close', 50)} AS l FROM bars)"


@query(f"WITH {_C} SELECT {K}, CASE WHEN s - l > 0 AND {lag('s')} - {lag('l')} <= 0 THEN 1 WHEN s - l < 0 AND {lag('s')} - {lag('l')} >= 0 THEN -1 ELSE 0 END AS event, CASE WHEN s > l THEN 1 WHEN s IS NOT NULL AND l IS NOT NULL THEN -1 END AS state FROM m")
def g01_g02_crosses(s, d):
    x = _b(s, d).select("symbol", "ts", R.sma("close", 20).alias("s"), R.sma("close", 50).alias("l"))
    return x.select("symbol", "ts", scores.cross_event("s", "l").alias("event"), scores.cross_state("s", "l").alias("state"))


_G4 = HOURLY + f", a AS (SELECT *, {roll('avg', 'close', 50)} AS s, {roll('avg', 'close', 200)} AS l FROM bars), g AS (SELECT *, abs(s - l) / nullif(l, 0) AS gap, {cl('(s - l) / nullif(l * 0.02, 0)')} AS c FROM a), h AS (SELECT *, {roll('avg', 'gap', 20)} AS h, (close - s) / nullif(s, 0) + (close - l) / nullif(l, 0) AS p, {ch('s', 5)} + {ch('l', 5)} AS sl FROM g)"
_MA = f"CASE WHEN s IS NOT NULL AND l IS NOT NULL AND p IS NOT NULL AND sl IS NOT NULL AND h IS NOT NULL THEN {cl('0.35 * c + 0.25 * ' + cl('p * 50') + ' + 0.25 * ' + cl('sl * 50') + ' + 0.15 * least(gap / nullif(h, 0), 2) / 2 * CASE WHEN c > 0 THEN 1 ELSE -1 END')} END"


@query(select(_G4, "h", K, 4, ma_score=_MA))
def g04_averages_score(s, d):
    return rounded(scores.averages_score(_b(s, d)).select("symbol", "ts", "ma_score"), 4)


_MP = "((high + low) / 2)"
_G5 = HOURLY + f", i AS (SELECT *, {roll('avg', _MP, 9)} AS t, {roll('avg', _MP, 26)} AS k, {roll('avg', _MP, 52)} AS sb, {ch('close', 5)} AS mo FROM bars), j AS (SELECT *, (t + k) / 2 AS sa FROM i), c AS (SELECT *, CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN greatest(sa, sb) END AS top, CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN least(sa, sb) END AS bot FROM j), p AS (SELECT *, top - bot AS th, CASE WHEN top - bot > 0 THEN CASE WHEN close > top THEN least((close - top) / (top - bot), 1) WHEN close < bot THEN greatest((close - bot) / (top - bot), -1) ELSE (close - bot) / (top - bot) - 0.5 END END AS pl FROM c)"


@query(select(_G5, "p", K, 4, ichimoku_score=f"CASE WHEN pl IS NOT NULL AND mo IS NOT NULL AND k IS NOT NULL AND k <> 0 THEN {cl('0.4 * pl + 0.3 * ' + cl('(t - k) / (th * 0.5)') + ' + 0.1 * least(th / (k * 0.1), 1) * CASE WHEN pl > 0 THEN 1 ELSE -1 END + 0.2 * ' + cl('mo * 20'))} END"))
def g05_ichimoku_score(s, d):
    x = _b(s, d)
    return rounded(scores.ichimoku_score(x.withColumns(I.ichimoku())).select("symbol", "ts", "ichimoku_score"), 4)


_S20, _M20 = roll("stddev_samp", "close", 20), roll("avg", "close", 20)
_G8 = HOURLY + f", b AS (SELECT *, {_M20} AS m, {_M20} + 2 * {_S20} AS u, {_M20} - 2 * {_S20} AS w, {ch('close', 5)} AS v FROM bars), q AS (SELECT *, (u - w) / nullif(m, 0) AS bw, {ch('m', 5)} AS sl, 2 * (CASE WHEN u - w > 0 THEN (close - w) / (u - w) WHEN u - w IS NOT NULL THEN 0 END - 0.5) AS p FROM b), r AS (SELECT *, {roll('avg', 'bw', 20)} AS bm FROM q)"


@query(select(_G8, "r", K, 4, bands_score=f"CASE WHEN p IS NOT NULL AND bm IS NOT NULL AND bm <> 0 AND sl IS NOT NULL AND v IS NOT NULL THEN {cl('0.35 * p + 0.25 * least(bw / bm, 2) / 2 * CASE WHEN p > 0 THEN 1 ELSE -1 END + 0.2 * ' + cl('sl * 20') + ' + 0.2 * ' + cl('v * 20'))} END"))
def g08_bands_score(s, d):
    return rounded(scores.bands_score(_b(s, d).withColumns(I.bollinger())).select("symbol", "ts", "bands_score"), 4)


@query()
def g06_g12_recursive_scores(s, d):
    x = recursive.recursive_columns(_b(s, d))
    x = scores.price_momentum_score(x, 10, 50)
    return rounded(x.select("symbol", "ts", scores.dmi_score().alias("dmi_score"), scores.psar_score().alias("psar_score"), scores.rsi_score().alias("rsi_score"), scores.macd_score().alias("macd_score"), "price_score", scores.smi_score().alias("smi_score")))


_W14 = HOURLY + ", w AS (SELECT *, " + ", ".join(f"({roll('max', 'high', n)} - close) / nullif({roll('max', 'high', n)} - {roll('min', 'low', n)}, 0) * -100 AS w{n}" for n in (14, 28, 42)) + f" FROM bars), x AS (SELECT *, {lag('w14')} AS p, {roll('min', 'w14', 5)} AS lo, {roll('max', 'w14', 5)} AS hi FROM w)"


@query(select(_W14, "x", K, 4, willr_score=f"CASE WHEN w14 IS NOT NULL AND w28 IS NOT NULL AND w42 IS NOT NULL AND p IS NOT NULL THEN {cl('0.3 * (w14 + 50) / 50 + 0.2 * (w14 - p) / 100 + 0.2 * CASE WHEN w14 >= -20 THEN (-20 - w14) / 20 WHEN w14 <= -80 THEN -(w14 + 80) / 20 ELSE 0 END + 0.15 * (0.5 * (w14 + 50) / 50 + 0.3 * (w28 + 50) / 50 + 0.2 * (w42 + 50) / 50) + 0.15 * CASE WHEN lo <= -80 AND w14 > -80 THEN 1 WHEN hi >= -20 AND w14 < -20 THEN -1 ELSE 0 END')} END"))
def g14_williams_score(s, d):
    x = _b(s, d)
    x = x.withColumns({f"willr_{n}": I.williams(n) for n in scores.WILLR})
    return rounded(x.select("symbol", "ts", scores.williams_score().alias("willr_score")), 4)


@query()
def g13_money_flow_score(s, d):
    x = I.with_money(_b(s, d)).withColumn("mfi", I.mfi(14))
    return rounded(x.select("symbol", "ts", scores.mfi_score().alias("mfi_score")))


_CS = CENTS + (
    f", c AS (SELECT *, abs(close - open) AS b, high - greatest(open, close) AS u, least(open, close) - low AS d, high - low AS r, {lag('open')} AS o1, {lag('close')} AS c1, {lag('high')} AS h1, {lag('low')} AS l1, {lag('open', 2)} AS o2, {lag('close', 2)} AS c2, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2 FROM bars), "
    f"e AS (SELECT *, {roll('avg', 'b', 20)} AS ab, {roll('avg', 'b', 5)} - {roll('avg', 'b', 20)} AS tr, {roll('avg', 'r', 20)} AS ar, {roll('avg', 'volume', 20)} AS av, abs(c1 - o1) AS b1, abs(c2 - o2) AS b2 FROM c)"
)


def _cap(a, b):
    return f"least(coalesce(({a}) / nullif({b}, 0), 2), 2)"


def _both(up, down, v):
    return f"CASE WHEN {up} THEN {v} WHEN {down} THEN -({v}) ELSE 0 END"


_TAIL = "CASE WHEN b = 0 THEN 0 ELSE {} END"
_UP3, _DN3 = "close > open AND close > c1", "close < open AND close < c1"
_SHAPES = {
    "hammer": f"CASE WHEN u <= b * 0.25 AND d >= b * 2 AND b >= ab * 0.3 THEN CASE WHEN tr < 0 THEN 1 ELSE -1 END * {_TAIL.format(_cap('d', 'b * 2'))} ELSE 0 END",
    "shooting_star": f"CASE WHEN u >= b * 2 AND d <= b * 0.25 AND b <= ab * 0.3 AND tr > 0 THEN -{_TAIL.format(_cap('u', 'b * 2'))} ELSE 0 END",
    "doji": "CASE WHEN b <= ab * 0.1 THEN CASE WHEN tr < 0 THEN 1 ELSE -1 END * CASE WHEN ab = 0 THEN 1 ELSE 1 - b / (ab * 0.1) END ELSE 0 END",
    "engulfing": _both("c1 < o1 AND close > open AND open < c1 AND close > o1", "c1 > o1 AND close < open AND open > c1 AND close < o1", _cap("b", "b1")),
    "harami": _both("c1 < o1 AND close > open AND open > c1 AND close < o1 AND b <= b1 * 0.6", "c1 > o1 AND close < open AND open < c1 AND close > o1 AND b <= b1 * 0.6", "1"),
    "tweezer": "CASE WHEN abs(high - h1) <= ar * 0.001 AND high > low THEN -1 WHEN abs(low - l1) <= ar * 0.001 AND low < high THEN 1 ELSE 0 END",
    "star": _both("c2 < o2 AND b1 < (b2 + b1 + b) / 3 * 0.25 AND close > open AND close > (o2 + c2) / 2", "c2 > o2 AND b1 < (b2 + b1 + b) / 3 * 0.25 AND close < open AND close < (o2 + c2) / 2", _cap("b", "b2")),
    "soldiers": _both(
        "c2 > o2 AND c1 > o1 AND close > open AND c1 > c2 AND close > c1 AND o1 > o2 AND open > o1 AND h2 - greatest(o2, c2) <= b2 * 0.2 AND h1 - greatest(o1, c1) <= b1 * 0.2 AND u <= b * 0.2",
        "c2 < o2 AND c1 < o1 AND close < open AND c1 < c2 AND close < c1 AND o1 < o2 AND open < o1 AND least(o2, c2) - l2 <= b2 * 0.2 AND least(o1, c1) - l1 <= b1 * 0.2 AND d <= b * 0.2", _cap("b2 + b1 + b", "b2 * 3"),
    ),
    "inside": _both(f"c2 < o2 AND c1 > o1 AND b1 < b2 * 0.7 AND {_UP3}", f"c2 > o2 AND c1 < o1 AND b1 < b2 * 0.7 AND {_DN3}", _cap("b", "b2")),
    "outside": _both(f"c2 < o2 AND c1 > o1 AND o1 < c2 AND c1 > o2 AND {_UP3}", f"c2 > o2 AND c1 < o1 AND o1 > c2 AND c1 < o2 AND {_DN3}", _cap("b", "b2")),
}


def _c(s, d):
    return schema.in_cents(_b(s, d))


@query(select(_CS, "e", K, 10, **{k: _SHAPES[k] for k in ("hammer", "shooting_star", "doji", "engulfing", "harami", "tweezer")}))
def g19_g20_candles(s, d):
    x = candles.double(candles.single(_c(s, d)))
    return rounded(x.select("symbol", "ts", *candles.SINGLE, *candles.DOUBLE), 10)


@query(select(_CS, "e", K, 10, **{k: _SHAPES[k] for k in ("star", "soldiers", "inside", "outside")}))
def g21_three_candles(s, d):
    return rounded(candles.triple(_c(s, d)).select("symbol", "ts", *candles.TRIPLE), 10)


_CONF = "tanh((CASE WHEN av = 0 THEN 0 ELSE (volume - av) / av END + CASE WHEN ar = 0 THEN 0 ELSE (r - ar) / ar END) * 2)"
_WEIGHTS = {"hammer": 0.35, "shooting_star": 0.35, "doji": 0.3, "engulfing": 0.4, "harami": 0.3, "tweezer": 0.3, "star": 0.3, "soldiers": 0.3, "inside": 0.2, "outside": 0.2}
_PART = lambda *names: "(" + " + ".join(f"{_WEIGHTS[n]} * {n}" for n in names) + ")"
_SCORE = f"0.25 * {_PART('hammer', 'shooting_star', 'doji')} + 0.3 * {_PART('engulfing', 'harami', 'tweezer')} + 0.3 * {_PART('star', 'soldiers', 'inside', 'outside')} + 0.15 * conf"


@query(select(_CS + f", f AS (SELECT symbol, ts, {_CONF} AS conf, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in _SHAPES.items())} FROM e)", "f", K, 5, confirmation="conf", candlestick_score=f"CASE WHEN conf IS NOT NULL THEN {cl(_SCORE)} END"))
def g22_confirmation(s, d):
    return rounded(candles.candlestick(_c(s, d)).select("symbol", "ts", "confirmation", "candlestick_score"), 5)


_Z = CENTS + f", z0 AS (SELECT *, close - {lag('close')} AS dd FROM bars), z1 AS (SELECT *, CASE WHEN dd IS NOT NULL THEN greatest(dd, 0) END AS g, CASE WHEN dd IS NOT NULL THEN greatest(-dd, 0) END AS l FROM z0), z AS (SELECT *, {lag('close')} AS p, {roll('stddev_samp', 'close', 20)} AS vol, {roll('avg', 'close', 10)} AS a, {roll('avg', 'close', 20)} AS m, {roll('avg', 'close', 50)} AS e, {roll('max', 'high', 10)} AS hi, {roll('min', 'low', 10)} AS lo, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al FROM z1), y AS (SELECT *, CASE WHEN al = 0 AND ag > 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi, first_value(vol IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS f FROM z)"


@query(
    f"WITH {_Z} SELECT {K}, CASE WHEN vol IS NULL THEN NULL WHEN vol < 0.5 * f THEN 'low' WHEN vol > 2 * f THEN 'high' ELSE 'normal' END AS vol_class, CASE WHEN rsi > 70 THEN 2 WHEN rsi > 60 THEN 1 WHEN rsi < 30 THEN -2 WHEN rsi < 40 THEN -1 ELSE 0 END AS rsi_zone, "
    "CASE WHEN close > m + 2 * vol THEN 2 WHEN close > m THEN 1 WHEN close < m - 2 * vol THEN -2 WHEN close < m THEN -1 ELSE 0 END AS band_zone, CASE WHEN close > a AND close > m AND close > e AND a > m AND m > e THEN 1 WHEN close < a AND close < m AND close < e AND a < m AND m < e THEN -1 ELSE 0 END AS trend, "
    "CASE WHEN close > hi AND p < hi THEN 1 WHEN close < lo AND p > lo THEN -1 WHEN abs((hi - close) / nullif(hi, 0)) < 0.01 AND close < p THEN -1 WHEN abs((close - lo) / nullif(close, 0)) < 0.01 AND close > p THEN 1 ELSE 0 END AS level_event FROM y"
)
def g29_classes(s, d):
    x = I.with_gains(_c(s, d)).withColumn("rsi", I.rsi(14))
    x = scores.volatility_class(scores.classes(x).withColumn("vol", R.std("close", 20)))
    return x.select("symbol", "ts", "vol_class", "rsi_zone", "band_zone", "trend", "level_event")


@query()
def g29_adx_class(s, d):
    return recursive.recursive_columns(_b(s, d)).select("symbol", "ts", scores.adx_class().alias("adx_class"))


@query(f"WITH {CENTS}, gl AS (SELECT *, close - {lag('close')} AS dd FROM bars), gm AS (SELECT *, {roll('avg', 'close', 5)} AS s, {roll('avg', 'close', 20)} AS l, {roll('avg', 'CASE WHEN dd IS NOT NULL THEN greatest(dd, 0) END', 14)} AS ag, {roll('avg', 'CASE WHEN dd IS NOT NULL THEN greatest(-dd, 0) END', 14)} AS al FROM gl), gr AS (SELECT *, CASE WHEN al = 0 AND ag > 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi FROM gm) SELECT {K}, CASE WHEN s > l AND rsi > 70 THEN 'SELL' WHEN s < l AND rsi < 30 THEN 'BUY' END AS action FROM gr")
def g03_average_rsi_rule(s, d):
    x = I.with_gains(_c(s, d)).withColumns({"rsi": I.rsi(14), "short": R.sma("close", 5), "long": R.sma("close", 20)})
    return x.select("symbol", "ts", scores.average_rsi_rule("short", "long", "rsi").alias("action"))


_G32 = CENTS + f", g AS (SELECT *, (close - {roll('min', 'low', 20)}) / nullif({roll('max', 'high', 20)} - {roll('min', 'low', 20)}, 0) AS k, close / nullif(max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd, close / nullif({lag('close', 20)}, 0) - 1 AS mo FROM bars)"


@query(select(_G32, "g", K, 5, leverage="CASE WHEN k IS NOT NULL AND dd IS NOT NULL AND mo IS NOT NULL THEN greatest(least((1.5 - k) * exp(4 * dd) * (1 + 0.5 * tanh(mo * 10)), 3), 0.2) END"))
def g32_leverage(s, d):
    x = _c(s, d).withColumns({"k": I.channel(20)["ch_pos"], "dd": I.drawdown()["drawdown"], "mo": R.ret("close", 20)})
    known = F.col("k").isNotNull() & F.col("dd").isNotNull() & F.col("mo").isNotNull()
    return rounded(x.select("symbol", "ts", F.when(known, scores.leverage(F.col("k"), F.col("dd"), F.col("mo"))).alias("leverage")), 5)


@query(select(HOURLY + ", w AS (SELECT *, CASE symbol WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.3 WHEN 'error' THEN 0.2 END AS wt FROM bars)", "w", "ts", 5, where="WHERE wt IS NOT NULL GROUP BY ts", high="sum(high * wt)", low="sum(low * wt)", close="sum(close * wt)"))
def g34_synthetic_index(s, d):
    w = s.createDataFrame([("click", 0.5), ("view", 0.3), ("error", 0.2)], "symbol string, weight double")
    return rounded(scores.synthetic_index(_b(s, d), w), 5)


@query(select(HOURLY + f", x AS (SELECT symbol, ts, close - open AS a, close - {lag('close')} AS b, high - 2 * close + low AS c FROM bars), y AS (SELECT *, greatest((a > 0)::INT + (b > 0)::INT + (c > 0)::INT, (a < 0)::INT + (b < 0)::INT + (c < 0)::INT, (a = 0)::INT + (b = 0)::INT + (c = 0)::INT) AS most FROM x WHERE b IS NOT NULL)", "y", K + ", CASE WHEN b > 1 THEN 'BUY' WHEN b < -1 THEN 'SELL' ELSE 'HOLD' END AS side", 5, trend_score="(a + b + c) / 3", confidence="most / 3"))
def g30_g33_agreement_sides(s, d):
    x = _b(s, d)
    x = x.select("symbol", "ts", (F.col("close") - F.col("open")).alias("a"), (F.col("close") - R.lag("close")).alias("b"), (F.col("high") - 2 * F.col("close") + F.col("low")).alias("c")).where("b is not null")
    return rounded(x.select("symbol", "ts", *(c.alias(n) for n, c in scores.agreement(["a", "b", "c"]).items()), scores.order_side(F.col("b"), 1.0)["side"].alias("side")), 5)


_V15 = HOURLY + ", v AS (SELECT *, " + ", ".join(f"{roll('stddev_samp', 'ret', n)} * sqrt(252) AS v{n}" for n in (5, 10, 21, 63)) + f", {roll('skewness', 'ret', 63)} AS sk, {roll('kurtosis', 'ret', 63)} AS ku FROM rets), w AS (SELECT *, " + ", ".join(f"CASE WHEN {roll('avg', f'v{n}', 21)} = 0 THEN 0 ELSE (v{n} - {roll('avg', f'v{n}', 21)}) / {roll('avg', f'v{n}', 21)} END AS d{n}" for n in (5, 10, 21, 63)) + " FROM v)"
_T15 = "0.35 * (0.4 * tanh(d5 / 0.5) + 0.3 * tanh(d10 / 0.5) + 0.2 * tanh(d21 / 0.5) + 0.1 * tanh(d63 / 0.5)) + 0.25 * tanh((v5 / v21 - 1) / 0.5) + 0.2 * tanh(0.4 * sk + 0.6 * (ku - 3)) + 0.2 * tanh((-1.5 * v5 - 0.5 * v10 + 0.5 * v21 + 1.5 * v63) / 5 / 0.5)"


@query(select(_V15, "w", K, 4, historical_score=f"CASE WHEN ({_T15}) IS NOT NULL THEN {cl(_T15)} END"))
def g15_historical_score(s, d):
    return rounded(scores.historical_score(_b(s, d)).select("symbol", "ts", "historical_score"), 4)


@query()
def g16_g17_garch_parkinson_scores(s, d):
    x = scores.garch_score(recursive.recursive_columns(_b(s, d)))
    return rounded(scores.parkinson_score(x).select("symbol", "ts", "garch_score", "parkinson_score"))


_G24 = HOURLY + ", e AS (SELECT symbol, min(low) AS lo, max(high) AS hi, (max(high) - min(low)) / 1000 AS step FROM bars GROUP BY symbol HAVING max(high) > min(low)), k AS (SELECT symbol, lo, hi, step, unnest(range(1000)) AS bin FROM e), b AS (SELECT symbol, floor((low - lo) / step) AS a, ceil((high - lo) / step) AS z, floor(exp(-(seq - 1) / 100.0::DOUBLE) * 1000000000000)::HUGEINT AS w FROM seqs JOIN e USING (symbol)), g AS (SELECT k.symbol, bin, count(*) AS touches, sum(w) AS w, any_value(lo) AS lo, any_value(hi) AS hi FROM k JOIN b ON k.symbol = b.symbol AND bin >= a AND bin < z GROUP BY k.symbol, bin HAVING count(*) >= 3), s AS (SELECT *, touches * w::DOUBLE / 1e12::DOUBLE AS strength, lo + (bin + 0.5) * (hi - lo) / 1000 AS price FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, bin)::INT AS rank FROM s)"


@query(select(_G24, "r", "symbol, rank, bin, touches", 4, where="WHERE rank <= 5", price="price", strength="strength"))
def g24_levels(s, d):
    return rounded(scores.levels(_b(s, d)), 4)


@query(select(_G24 + ", q AS (SELECT symbol, arg_max(close, ts) AS c FROM bars GROUP BY symbol), v AS (SELECT q.symbol, (c - price) / price AS d, strength FROM q LEFT JOIN r ON q.symbol = r.symbol AND rank <= 5)", "v", "symbol", 5, where="GROUP BY symbol", level_signal="coalesce(tanh(sum(-sign(d) * exp(-abs(d) * 10) * strength) / sum(strength) * 2), 0)"))
def g24_level_signal(s, d):
    b = _b(s, d)
    return rounded(scores.level_signal(b, scores.levels(b)), 5)


_W25 = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_G25 = HOURLY + f", h AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 20 PRECEDING) AS h, min(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 20 PRECEDING) AS l FROM seqs), k AS (SELECT *, CASE WHEN seq > 1 THEN regr_slope(h, seq) {_W25} ELSE 0 END AS hs, CASE WHEN seq > 1 THEN regr_slope(l, seq) {_W25} ELSE 0 END AS ls FROM h)"


def _line(level, slope):
    d = f"((close - ({level} + {slope})) / nullif({level} + {slope}, 0))"
    return f"(CASE WHEN abs({slope}) < 0.0001 THEN 0 WHEN abs({d}) < 0.02 THEN sign({slope}) * 0.5 ELSE -sign({d}) * sign({slope}) END)"


@query(select(_G25, "k", K, 4, high_slope="hs", low_slope="ls", trend_signal=f"tanh(({_line('h', 'hs')} + {_line('l', 'ls')}) * 2)"))
def g25_trendline(s, d):
    return rounded(scores.trendline(_b(s, d)).select("symbol", "ts", "high_slope", "low_slope", "trend_signal"), 4)


@query()
def g18_g28_yang_zhang_blend(s, d):
    x = recursive.recursive_columns(_b(s, d).withColumns(I.ichimoku() | I.bollinger()))
    x = scores.yang_zhang_score(scores.bands_score(scores.ichimoku_score(x)))
    x = x.select("symbol", "ts", "yang_zhang_score", "ichimoku_score", "bands_score", scores.dmi_score().alias("dmi"), scores.rsi_score().alias("rsi_score"))
    trend = scores.family({"ichimoku": 0.4, "bands": 0.3, "dmi": 0.3}, {"ichimoku": "ichimoku_score", "bands": "bands_score", "dmi": "dmi"})
    x = x.withColumns({"trend": trend, "pattern": F.lit(0.0)})
    return rounded(x.select("symbol", "ts", "yang_zhang_score", "trend", scores.blend({"trend": "trend", "momentum": "rsi_score", "volatility": "yang_zhang_score", "pattern": "pattern"}).alias("blend")))


def _over(c):
    m = roll("avg", c, 20)
    return f"(CASE WHEN {m} = 0 THEN 0 ELSE {roll('avg', c, 5)} / {m} - 1 END)"


_G27 = CENTS + (
    f", v0 AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS pc, volume / nullif({lag('volume')}, 0) - 1 AS vc, close / nullif({lag('close', 5)}, 0) - 1 AS m5, close / nullif({lag('close', 19)}, 0) - 1 AS m19, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS f0 FROM bars), "
    f"v1 AS (SELECT *, pc * vc AS f, sum(f0) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ad, {_over('close')} AS pt, {_over('volume')} AS vt FROM v0), "
    f"v2 AS (SELECT *, CASE WHEN count(CASE WHEN pc IS NOT NULL AND vc IS NOT NULL THEN 1 END) {over(20)} = 20 THEN corr(pc, vc) {over(20)} END AS co, {roll('avg', 'f', 10)} AS fs, {roll('avg', 'ad', 5)} / nullif({roll('avg', 'ad', 20)}, 0) - 1 AS am, CASE WHEN {roll('stddev_samp', 'volume', 20)} = 0 THEN 0 ELSE (volume - {roll('avg', 'volume', 20)}) / {roll('stddev_samp', 'volume', 20)} END AS z FROM v1), "
    "v3 AS (SELECT symbol, ts, CASE WHEN pt IS NULL OR vt IS NULL THEN NULL WHEN pt < -0.02 AND vt > 0 THEN vt * 2 WHEN pt > 0.02 AND vt < 0 THEN -vt * 2 ELSE tanh(vt * 2) END AS a, tanh((-co + sign(fs)) * 2) AS b, CASE WHEN z IS NULL OR m5 IS NULL THEN NULL WHEN abs(z) > 3 AND m5 > 0.02 THEN -1 WHEN abs(z) > 3 AND m5 < -0.02 THEN 1 ELSE tanh(z * sign(m5) * 1.5) END AS c, CASE WHEN m19 IS NULL OR am IS NULL THEN NULL WHEN m19 < -0.02 AND am > 0 THEN am * 2 WHEN m19 > 0.02 AND am < 0 THEN am * 2 ELSE tanh(am * 1.5) END AS e FROM v2)"
)


@query(select(_G27, "v3", K, 4, volume_trend="a", price_volume="b", volume_burst="c", accumulation="e", volume_score=f"CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL THEN {cl('0.3 * a + 0.25 * b + 0.25 * c + 0.2 * e')} END"))
def g27_volume_divergence(s, d):
    return rounded(scores.volume_score(_c(s, d)).select("symbol", "ts", *scores.VOLUME, "volume_score"), 4)


_SW = lambda c, f, op, jump: f"coalesce(count({c}) OVER pre = 5 AND count({c}) OVER post = 5 AND {c} {op} {f}({c}) OVER pre AND {c} {op} {f}({c}) OVER post AND {c} {op} lag({c}) OVER al * {jump}, false)"
_G23 = HOURLY + (
    f", s0 AS (SELECT *, {_SW('high', 'max', '>', 1.01)} AS sh, {_SW('low', 'min', '<', 0.99)} AS sl FROM bars WINDOW al AS (PARTITION BY symbol ORDER BY ts), pre AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), post AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)), "
    "s1 AS (SELECT *, CASE WHEN sh AND row_number() OVER a >= 4 THEN [lag(high, 3) OVER a, lag(high, 2) OVER a, lag(high) OVER a, high] END AS h, CASE WHEN sl AND row_number() OVER b >= 4 THEN [lag(low, 3) OVER b, lag(low, 2) OVER b, lag(low) OVER b, low] END AS l FROM s0 WINDOW a AS (PARTITION BY symbol, sh ORDER BY ts), b AS (PARTITION BY symbol, sl ORDER BY ts)), "
    "s2 AS (SELECT symbol, ts, last_value(h IGNORE NULLS) OVER w AS h, last_value(l IGNORE NULLS) OVER w AS l FROM s1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)), "
    "s3 AS (SELECT symbol, ts, [h[1], l[2], h[3], l[4]] AS u, [l[1], h[2], l[3], h[4]] AS d FROM s2), "
    "s4 AS (SELECT symbol, ts, " + ", ".join(f"[abs(({p}[3] - {p}[2]) / nullif({p}[2] - {p}[1], 0)), abs(({p}[4] - {p}[3]) / nullif({p}[3] - {p}[2], 0)), abs(({p}[4] - {p}[2]) / nullif({p}[2] - {p}[1], 0))] AS {p}" for p in "ud") + " FROM s3)"
)


def _harmonic(p, targets):
    near = [f"(1 - abs({p}[{i + 1}] - {t}) / (0.05 * {t}))" for i, t in enumerate(targets)]
    return f"(CASE WHEN {' AND '.join(f'{n} >= 0' for n in near)} THEN ({' + '.join(near)}) / 3 ELSE 0 END)"


_HA = {n: f"coalesce(({_harmonic('u', t)} - {_harmonic('d', t)}) / nullif(({_harmonic('u', t)} > 0)::INT + ({_harmonic('d', t)} > 0)::INT, 0), 0)" for n, (_, *t) in patterns.HARMONICS.items()}


@query(select(_G23, "s4", K, 6, **_HA, harmonic=" + ".join(f"{patterns.HARMONICS[n][0]} * {e}" for n, e in _HA.items())))
def g23_harmonics(s, d):
    return rounded(patterns.harmonics(_b(s, d)).select("symbol", "ts", *patterns.HARMONICS, "harmonic"))


@query()
def g26_formations(s, d):
    return rounded(patterns.formations(_b(s, d)).select("symbol", "ts", "head_shoulders", "double", "triangle", "rectangle"))
