"""Recursive columns as queries; their SQL walks the bars one by one in a recursive table expression."""

from __future__ import annotations

from .. import schema
from ..operators import regimes, scan
from .sql import HOURLY, lag, roll, rounded

QUERIES, ORACLES = {}, {}


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = text
        return f

    return add


#: Bars with what a step needs of the bar before.
STEPS = HOURLY + """,
st AS (SELECT symbol, seq, ts, high, low, close, ret, lag(ret) OVER w AS prev_ret, close - lag(close) OVER w AS mv, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn,
  lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(low, 2) OVER w AS l2, lag(high, 2) OVER w AS h2,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY seq))"""


def _ema(n: int) -> str:
    return f"b.close * {2 / (n + 1)!r}::DOUBLE + r.e{n} * {1 - 2 / (n + 1)!r}::DOUBLE AS e{n}"


def _wilder(name: str, value: str) -> str:
    return f"CASE WHEN b.seq <= 15 THEN r.{name} + {value} / 14 ELSE (r.{name} * 13 + {value}) / 14 END AS {name}"


_EMAS = (12, 20, 26, 40, 60, 80)
WALK = f"""RECURSIVE {STEPS}, r AS (
  SELECT symbol, seq, ts, close, {", ".join(f"close AS e{n}" for n in _EMAS)}, 0.0::DOUBLE AS num, 0.0::DOUBLE AS den, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, 0.0::DOUBLE AS tr, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m,
    0.0::DOUBLE AS sq, 0.0::DOUBLE AS v, 0.0::DOUBLE AS line, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS adx FROM st WHERE seq = 1
  UNION ALL
  SELECT symbol, seq, ts, close, {", ".join(f"e{n}" for n in _EMAS)}, num, den, g, l, tr, p, m, sq, v, line, line * 0.2::DOUBLE + sig * 0.8::DOUBLE AS sig, dx,
    CASE WHEN seq < 15 THEN 0 WHEN seq <= 28 THEN adx + dx / 14 ELSE (adx * 13 + dx) / 14 END AS adx
  FROM (SELECT *, e12 - e26 AS line, CASE WHEN tr > 0 AND p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END AS dx FROM (
    SELECT b.symbol, b.seq, b.ts, b.close, {", ".join(map(_ema, _EMAS))}, r.num * 0.7::DOUBLE + coalesce(b.ret, 0) AS num, r.den * 0.7::DOUBLE + CASE WHEN b.ret IS NULL THEN 0 ELSE 1 END AS den,
      {_wilder("g", "greatest(b.mv, 0)")}, {_wilder("l", "greatest(-b.mv, 0)")}, {_wilder("tr", "b.tr")},
      {_wilder("p", "CASE WHEN b.up > b.dn AND b.up > 0 THEN b.up ELSE 0 END")}, {_wilder("m", "CASE WHEN b.dn > b.up AND b.dn > 0 THEN b.dn ELSE 0 END")},
      r.sq + coalesce(b.ret * b.ret, 0) AS sq, CASE WHEN b.seq = 21 THEN (r.sq + coalesce(b.ret * b.ret, 0)) / 20 WHEN b.seq > 21 THEN 2.5e-5::DOUBLE + 0.1::DOUBLE * coalesce(b.prev_ret * b.prev_ret, 0) + 0.85::DOUBLE * r.v ELSE 0 END AS v,
      r.sig, r.adx
    FROM r JOIN st b ON b.symbol = r.symbol AND b.seq = r.seq + 1))
)"""


def _r(c: str, name: str, first: int = 1, digits: int = 6) -> str:
    return f"CASE WHEN seq >= {first} THEN round({c}, {digits}) + 0.0::DOUBLE END AS {name}"


_SCANNED = [
    _r("e12", "ema_12"), _r("e26", "ema_26"), _r("e20 / nullif(close, 0)", "ema_rel_20"), _r("e40 / nullif(close, 0)", "ema_rel_40"), _r("(e20 - e40) / nullif(close, 0)", "ema_delta_20_40"), _r("num / nullif(den, 0)", "ewm_03"),
    _r("CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END", "rsi", 15), _r("line", "macd"), _r("sig", "macd_signal"), _r("line - sig", "macd_hist"), _r("tr", "atr", 15), _r("100 * p / nullif(tr, 0)", "plus_di", 15),
    _r("100 * m / nullif(tr, 0)", "minus_di", 15), _r("adx", "adx", 28), _r("v", "garch", 21),
]


@query(f"WITH {WALK} SELECT symbol, ts, {', '.join(_SCANNED)} FROM r")
def w07_w39_scanned(s, d):
    """W7, W9, W11, W12, W27, W29, W39 by composed maps."""
    return rounded(scan.scanned_columns(schema.bars(s, d)).select("symbol", "ts", *scan.FIELDS))


_GRID = (20, 40, 60, 80)


@query(f"WITH {WALK} SELECT symbol, ts, {', '.join([_r(f'e{n} / nullif(close, 0)', f'ema_rel_{n}') for n in _GRID] + [_r(f'(e{a} - e{b}) / nullif(close, 0)', f'ema_delta_{a}_{b}') for i, a in enumerate(_GRID) for b in _GRID[i + 1:]])} FROM r")
def w08_ema_grid_scanned(s, d):
    return rounded(scan.ema_grid(schema.bars(s, d)).drop("open", "high", "low", "close", "volume", "n"))


def _mean(*names: str) -> str:
    return f"({' + '.join(names)}) / {len(names)}.0::DOUBLE"


def _most(op: str) -> str:
    return " + ".join(f"({s} {op} 0)::INT" for s in ("x1", "x2", "x3", "y1", "y2", "y3", "v1", "v2", "v3", "w1", "w2"))


_W = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
#: The eleven signals of a bar, prices in cents: trend x, momentum y, volatility v, pattern w.
DETECT = WALK.replace("value AS price", "round(value * 100) AS price") + f""",
q0 AS (SELECT symbol, seq, ts, r.close, st.high, st.low, st.ret, CASE WHEN seq >= 28 THEN adx END AS adx, CASE WHEN seq >= 15 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi,
  line, sig, CASE WHEN seq >= 15 THEN r.tr END AS atr FROM r JOIN (SELECT symbol, seq, high, low, ret FROM st) st USING (symbol, seq)),
q1 AS (SELECT *, {lag("close")} AS p, {roll("avg", "close", 50)} AS s, {roll("avg", "close", 200)} AS lg, {roll("stddev_samp", "ret", 24)} * sqrt(8760) AS vol, {roll("avg", "atr", 5)} AS a5, {roll("avg", "atr", 20)} AS a20,
  {roll("avg", "close", 20)} AS m, {roll("stddev_samp", "close", 20)} AS d, {roll("avg", "close", 10)} AS a10, {roll("max", "high", 10)} AS hi, {roll("min", "low", 10)} AS lo FROM q0),
q2 AS (SELECT *, first_value(vol IGNORE NULLS) {_W} AS v0, {lag("lg", 5)} AS lg5 FROM q1),
q3 AS (SELECT *, lg IS NOT NULL AND a20 IS NOT NULL AND vol IS NOT NULL AND adx IS NOT NULL AND rsi IS NOT NULL AS known,
  CASE WHEN s > lg THEN 1 ELSE -1 END AS x1, CASE WHEN close > lg THEN 1 ELSE -1 END AS x2, coalesce(sign(lg - lg5), 0)::INT AS x3,
  CASE WHEN line > sig THEN 1 ELSE -1 END AS y1, CASE WHEN rsi > 70 THEN 2 WHEN rsi > 60 THEN 1 WHEN rsi < 30 THEN -2 WHEN rsi < 40 THEN -1 ELSE 0 END AS y2, CASE WHEN adx > 40 THEN 2 WHEN adx > 25 THEN 1 WHEN adx < 15 THEN -1 ELSE 0 END AS y3,
  CASE WHEN vol > 2 * v0 THEN 1 WHEN vol < 0.5 * v0 THEN -1 ELSE 0 END AS v1, CASE WHEN a5 > a20 * 1.1::DOUBLE THEN 1 WHEN a5 < a20 * 0.9::DOUBLE THEN -1 ELSE 0 END AS v2,
  CASE WHEN close > m + 2 * d THEN 2 WHEN close > m THEN 1 WHEN close < m - 2 * d THEN -2 WHEN close < m THEN -1 ELSE 0 END AS v3,
  CASE WHEN close > a10 AND close > m AND close > s AND a10 > m AND m > s THEN 1 WHEN close < a10 AND close < m AND close < s AND a10 < m AND m < s THEN -1 ELSE 0 END AS w1,
  CASE WHEN close > hi AND p < hi THEN 1 WHEN close < lo AND p > lo THEN -1 WHEN abs((hi - close) / nullif(hi, 0)) < 0.01 AND close < p THEN -1 WHEN abs((close - lo) / nullif(close, 0)) < 0.01 AND close > p THEN 1 ELSE 0 END AS w2 FROM q2),
q4 AS MATERIALIZED (SELECT *, CASE WHEN known THEN 0.4::DOUBLE * 1.2::DOUBLE * {_mean("x1", "x2", "x3")} + 0.3::DOUBLE * {_mean("y1", "y2", "y3")} + 0.2::DOUBLE * {_mean("v1", "v2", "v3")} + 0.1::DOUBLE * {_mean("w1", "w2")} END AS score,
  CASE WHEN known THEN greatest({_most(">")}, {_most("<")}, {_most("=")}) / 11.0::DOUBLE * CASE WHEN v1 <> 0 THEN 0.8::DOUBLE ELSE 1 END END AS conf FROM q3)"""
#: The state that follows from a bar's score and the state before it.
_STEP = """CASE WHEN b.score IS NULL THEN {was} WHEN b.conf > CASE WHEN abs(b.score) > 0.3 THEN 0.25 ELSE 0.3 END THEN
  CASE WHEN b.score > CASE {was} WHEN 1 THEN -0.25 WHEN -1 THEN 0.25 ELSE 0.2 END THEN 1 WHEN b.score < -CASE {was} WHEN 1 THEN -0.25 WHEN -1 THEN 0.25 ELSE 0.2 END THEN -1 ELSE 0 END ELSE 0 END"""
REGIME = DETECT + f""", h AS (
  SELECT symbol, seq, {_STEP.format(was="0")} AS regime FROM q4 b WHERE seq = 1
  UNION ALL SELECT b.symbol, b.seq, {_STEP.format(was="h.regime")} FROM h JOIN q4 b ON b.symbol = h.symbol AND b.seq = h.seq + 1)"""
_BACK = {5: 4, 10: 9, 20: 19, 30: 29}
_MOMENTUM = (
    "0.4::DOUBLE * (" + " + ".join(f"coalesce(close > {lag('close', k)}, false)::INT" for k in _BACK.values()) + ") / 4 + 0.3::DOUBLE * ("
    + " + ".join(f"coalesce({roll('avg', 'close', a)} > {roll('avg', 'close', b)}, false)::INT" for a, b in ((5, 10), (10, 20), (20, 30))) + ") / 3 + 0.2::DOUBLE * ("
    + " + ".join(f"coalesce(close > {roll('avg', 'close', n)}, false)::INT" for n in _BACK) + f") / 4 + 0.1::DOUBLE * coalesce(close > {lag('close', 4)} AND close > {lag('close', 9)}, false)::INT"
)
LEVERAGE = REGIME + f""",
k AS (SELECT q4.*, h.regime, CASE WHEN seq >= 20 THEN 0.2::DOUBLE * (close / {lag("close")} - 1) + 0.3::DOUBLE * (close / {lag("close", 4)} - 1) + 0.5::DOUBLE * (close / {lag("close", 19)} - 1) ELSE 0 END AS dn,
  CASE WHEN seq >= 50 THEN {_MOMENTUM} ELSE 0 END AS mo, greatest(0, least(1, (vol - 0.5 * v0) / (1.5 * v0))) AS pl FROM q4 JOIN h USING (symbol, seq)),
o AS (SELECT *, CASE WHEN regime > 0 THEN (2 + 3 * (regime + 1)) * (1 + 1.2::DOUBLE * (score + 1)) ELSE (1 + 0.5 * (regime + 1)) * (1 + 0.3::DOUBLE * (score + 1)) END
  * (1 - pl * 0.2::DOUBLE * CASE WHEN regime > 0 THEN 0.2 ELSE 1.2 END) * CASE WHEN dn >= 0 THEN 1 + dn ELSE exp(4 * dn) END
  * CASE WHEN mo > 0.2 AND pl < 0.6 AND conf > 0.4 THEN least(4, 1 + (mo - 0.2) * 5 + (0.6 - pl) * 3 + (conf - 0.4) * 3) ELSE 1 END AS total FROM k)"""


def _detected(s, d):
    return regimes.detect(schema.in_cents(schema.bars(s, d)))


@query(f"WITH {DETECT} SELECT symbol, ts, round(score, 6) + 0.0::DOUBLE AS trend_score, round(conf, 6) + 0.0::DOUBLE AS confidence FROM q4")
def g30_trend_score(s, d):
    x = regimes.signals(scan.scanned_columns(schema.in_cents(schema.bars(s, d))))
    return rounded(x.select("symbol", "ts", regimes.trend_score().alias("trend_score"), regimes.confidence().alias("confidence")))


@query(f"WITH {REGIME} SELECT symbol, ts, regime::INT AS regime FROM q4 JOIN h USING (symbol, seq)")
def g31_regime(s, d):
    x = regimes.signals(scan.scanned_columns(schema.in_cents(schema.bars(s, d))))
    return regimes.regimes(x.select("symbol", "ts", regimes.trend_score().alias("trend_score"), regimes.confidence().alias("confidence"))).select("symbol", "ts", "regime")


@query(f"WITH {LEVERAGE} SELECT symbol, ts, CASE WHEN total IS NOT NULL THEN round(greatest(1, least(CASE WHEN regime > 0 THEN 5 ELSE 2.5 END, total)), 5) + 0.0::DOUBLE END AS leverage FROM o")
def g32_regime_leverage(s, d):
    return rounded(_detected(s, d).select("symbol", "ts", "leverage"), 5)


@query(f"WITH {WALK} SELECT symbol, ts, CASE WHEN seq < 28 THEN 0 WHEN adx > 40 THEN 2 WHEN adx > 25 THEN 1 WHEN adx < 15 THEN -1 ELSE 0 END::INT AS adx_class FROM r")
def g29_adx_class_scanned(s, d):
    from ..operators import scores

    return scan.scanned_columns(schema.bars(s, d)).select("symbol", "ts", scores.adx_class().alias("adx_class"))


def g28_families(s, d):
    """The four families and their blend for each symbol's last bar; members are tested one by one, so it has no SQL."""
    return rounded(regimes.families(schema.bars(s, d)))


QUERIES["g28_families"] = g28_families


# SQL of queries that are registered elsewhere: the recursive columns and the scores over them.

def _sar(x: str, step: float, most: float) -> tuple[str, str, str, str, str]:
    """The parabolic stop in five steps: state before, level, turn, state after, next level."""
    first = "b.seq = 2"
    return (
        f"CASE WHEN {first} THEN b.up >= b.dn ELSE r.{x}l END AS {x}l0, CASE WHEN {first} THEN CASE WHEN b.up >= b.dn THEN b.l1 ELSE b.h1 END ELSE r.{x}n END AS {x}s0, CASE WHEN {first} THEN CASE WHEN b.up >= b.dn THEN b.high ELSE b.low END ELSE r.{x}e END AS {x}e0, CASE WHEN {first} THEN {step} ELSE r.{x}a END AS {x}a0",
        f"CASE WHEN {x}l0 THEN least({x}s0, l1, coalesce(l2, l1)) ELSE greatest({x}s0, h1, coalesce(h2, h1)) END AS {x}s1",
        f"CASE WHEN {x}l0 THEN low <= {x}s1 ELSE high >= {x}s1 END AS {x}f",
        f"{x}l0 <> {x}f AS {x}l, CASE WHEN {x}f THEN CASE WHEN {x}l0 THEN greatest({x}e0, high) ELSE least({x}e0, low) END ELSE {x}s1 END AS {x}o, "
        f"CASE WHEN {x}f THEN CASE WHEN {x}l0 THEN low ELSE high END WHEN {x}l0 THEN greatest({x}e0, high) ELSE least({x}e0, low) END AS {x}e, "
        f"CASE WHEN {x}f THEN {step} WHEN {x}l0 AND high > {x}e0 OR NOT {x}l0 AND low < {x}e0 THEN least({most}, {x}a0 + {step}) ELSE {x}a0 END AS {x}a",
        f"{x}o + {x}a * ({x}e - {x}o) AS {x}n",
    )


_SARS = [_sar("f", "0.02::DOUBLE", "0.2::DOUBLE"), _sar("s", "0.01::DOUBLE", "0.1::DOUBLE")]
_STATE = ", ".join(f"{x}l, {x}o, {x}e, {x}a, {x}n" for x in "fs")
_SUMS = "n1, q1, d1, n2, q2, d2, gs, gd"
#: The stops and the stochastic momentum index; a mean of a mean is null until its first value, and weights decay on every bar.
EXTRA = f"""sx AS (SELECT *, CASE WHEN seq >= 10 THEN max(high) OVER w10 END AS hh, CASE WHEN seq >= 10 THEN min(low) OVER w10 END AS ll FROM st WINDOW w10 AS (PARTITION BY symbol ORDER BY seq ROWS 9 PRECEDING)),
e AS (
  SELECT symbol, seq, {", ".join(f"NULL::BOOLEAN AS {x}l, NULL::DOUBLE AS {x}o, NULL::DOUBLE AS {x}e, NULL::DOUBLE AS {x}a, NULL::DOUBLE AS {x}n" for x in "fs")}, {", ".join(f"0.0::DOUBLE AS {c}" for c in _SUMS.split(", "))}, NULL::DOUBLE AS smi FROM sx WHERE seq = 1
  UNION ALL
  SELECT symbol, seq, {_STATE}, n1, q1, d1, n2, q2, d2, gs * (9.0::DOUBLE / 11) + coalesce(smi, 0) AS gs, gd * (9.0::DOUBLE / 11) + CASE WHEN smi IS NULL THEN 0 ELSE 1 END AS gd, smi FROM (
    SELECT *, {", ".join(x[4] for x in _SARS)}, CASE WHEN q2 <> 0 THEN 100 * n2 / q2 END AS smi FROM (
      SELECT *, {", ".join(x[3] for x in _SARS)}, p2n * 0.5 + CASE WHEN d1 > 0 THEN n1 / d1 ELSE 0 END AS n2, p2q * 0.5 + CASE WHEN d1 > 0 THEN q1 / d1 ELSE 0 END AS q2, p2d * 0.5 + CASE WHEN d1 > 0 THEN 1 ELSE 0 END AS d2 FROM (
        SELECT *, {", ".join(x[2] for x in _SARS)} FROM (
          SELECT *, {", ".join(x[1] for x in _SARS)} FROM (
            SELECT b.symbol, b.seq, b.high, b.low, b.h1, b.l1, b.h2, b.l2, {", ".join(x[0] for x in _SARS)}, r.n2 AS p2n, r.q2 AS p2q, r.d2 AS p2d, r.gs, r.gd,
              r.n1 * 0.5 + coalesce(b.close - (b.hh + b.ll) / 2, 0) AS n1, r.q1 * 0.5 + coalesce((b.hh - b.ll) / 2, 0) AS q1, r.d1 * 0.5 + CASE WHEN b.hh IS NULL THEN 0 ELSE 1 END AS d1
            FROM e r JOIN sx b ON b.symbol = r.symbol AND b.seq = r.seq + 1)))))
)"""
#: Every recursive column of a bar, null where it has no value.
FULL = WALK + ", " + EXTRA + f""",
a0 AS (SELECT symbol, seq, ts, r.close, bars.open, bars.high, bars.low, bars.volume, bars.n, e12 AS ema_12, e26 AS ema_26, e20 / nullif(r.close, 0) AS ema_rel_20, e40 / nullif(r.close, 0) AS ema_rel_40, (e20 - e40) / nullif(r.close, 0) AS ema_delta_20_40,
  num / nullif(den, 0) AS ewm_03, CASE WHEN seq >= 15 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi, line AS macd, sig AS macd_signal, line - sig AS macd_hist, CASE WHEN seq >= 15 THEN r.tr END AS atr,
  CASE WHEN seq >= 15 THEN 100 * p / nullif(r.tr, 0) END AS plus_di, CASE WHEN seq >= 15 THEN 100 * m / nullif(r.tr, 0) END AS minus_di, CASE WHEN seq >= 28 THEN adx END AS adx, fo AS sar_fast, so AS sar_slow, smi, gs / nullif(gd, 0) AS smi_signal,
  CASE WHEN seq >= 21 THEN v END AS garch, st.ret FROM r JOIN (SELECT symbol, seq, {_STATE}, smi, gs, gd FROM e) e USING (symbol, seq) JOIN (SELECT symbol, seq, ret FROM st) st USING (symbol, seq) JOIN bars USING (symbol, ts)),
a1 AS MATERIALIZED (SELECT *, (adx + {lag("adx", 13)}) / 2 AS adxr, {" + ".join(f"{0.9 ** k / sum(0.9 ** i for i in range(12))!r}::DOUBLE * " + (lag("ret", k) if k else "ret") for k in range(12))} AS ewm_win FROM a0)"""

_ALL = ["ema_12", "ema_26", "ema_rel_20", "ema_rel_40", "ema_delta_20_40", "ewm_03", "ewm_win", "rsi", "macd", "macd_signal", "macd_hist", "atr", "plus_di", "minus_di", "adx", "adxr", "sar_fast", "sar_slow", "smi", "smi_signal", "garch"]
ORACLES["w07_w39_recursive"] = f"WITH {FULL} SELECT symbol, ts, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in ['open', 'high', 'low', 'close', 'volume'])}, n, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in _ALL)} FROM a1"
ORACLES["w08_ema_grid"] = ORACLES["w08_ema_grid_scanned"]
ORACLES["g29_adx_class"] = ORACLES["g29_adx_class_scanned"]


def _lim(c: str) -> str:
    return f"greatest(least({c}, 1), -1)"


def _score(parts: list[tuple[float, str]]) -> str:
    """The limited weighted sum, null if a part is."""
    some = " AND ".join(f"({c}) IS NOT NULL" for _, c in parts)
    total = " + ".join(f"{w}::DOUBLE * ({c})" for w, c in parts)
    return f"CASE WHEN {some} THEN {_lim(total)} END"


def _maybe(c: str, scale: float = 1.0) -> str:
    return f"CASE WHEN ({c}) IS NOT NULL THEN {_lim(f'({c}) * {scale}::DOUBLE')} END"


def _change(c: str, d: int) -> str:
    return f"(({c} - {lag(c, d - 1)}) / nullif({lag(c, d - 1)}, 0))"


def _side(c: str) -> str:
    return f"CASE WHEN ({c}) > 0 THEN 1 ELSE -1 END"


def _crossing(now: str, was: str, size: str) -> str:
    return f"CASE WHEN {now} > 0 AND {was} <= 0 THEN 1 WHEN {now} < 0 AND {was} >= 0 THEN -1 ELSE {size} END"


def _near(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL AND close <> 0 THEN least(abs(close - {v}) / close / 0.05::DOUBLE, 1) * {_side(f'close - {v}')} END"


_BY = "(abs(macd) + 1e-8::DOUBLE)"
_RECURSIVE_SCORES = {
    "dmi_score": _score([(0.4, "rel * strong"), (0.3, f"strong * {_side('rel')}"), (0.15, f"{_maybe(_change('adx', 5), 10)} * {_side('rel')}"), (0.15, _maybe("(pm - pm1) / 5"))]),
    "psar_score": _score([(0.3, _near("sar_fast")), (0.3, _near("sar_slow")), (0.2, "CASE WHEN sf1 > c1 AND close > sar_fast THEN 1 WHEN sf1 < c1 AND close < sar_fast THEN -1 ELSE 0 END"), (0.2, _maybe(_change("close", 5), 20))]),
    "rsi_score": _score([(0.6, "(rsi - 50) / 50"), (0.2, "(rsi - rsi1) / 100"), (0.2, "CASE WHEN rsi >= 70 THEN (rsi - 70) / 30 WHEN rsi <= 30 THEN (rsi - 30) / 30 ELSE 0 END")]),
    "macd_score": _score([(0.3, _crossing("macd_hist", "hist1", f"macd_hist / {_BY}")), (0.2, _maybe(f"macd_hist / {_BY}")), (0.2, _maybe("(macd_hist - hist1) / (abs(macd_hist) + 1e-8::DOUBLE)")), (0.15, _maybe(f"(macd - macd1) / {_BY}")), (0.15, _maybe(f"macd / {_BY}"))]),
    "price_score": _score([
        (0.35, " + ".join(f"{w}::DOUBLE * tanh({_change('close', d)} / 0.1::DOUBLE)" for d, w in ((5, 0.4), (10, 0.3), (20, 0.2), (30, 0.1)))), (0.25, "tanh((ret - ret1) / 0.02::DOUBLE)"), (0.2, "tanh((cv - cv1) / 0.05::DOUBLE)"),
        (0.2, f"tanh(((close - {lag('close', 4)}) / nullif(atr * 5, 0)) / 2)"),
    ]),
    "smi_score": _score([(0.4, "smi / 100"), (0.2, "(smi - smi1) / 100"), (0.25, _crossing("(smi - smi_signal)", "gap1", "(smi - smi_signal) / 100")), (0.15, "CASE WHEN abs(smi) > 40 THEN (abs(smi) - 40) / 60 * sign(smi) ELSE 0 END")]),
}
SCORED = FULL + f""",
b0 AS (SELECT *, plus_di - minus_di AS pm, CASE WHEN plus_di + minus_di > 0 THEN (plus_di - minus_di) / (plus_di + minus_di) WHEN plus_di + minus_di IS NOT NULL THEN 0 END AS rel, CASE WHEN adx IS NOT NULL THEN least(adx / 50, 1) END AS strong,
  ({roll("avg", "close", 10)} - {roll("avg", "close", 50)}) / nullif({roll("avg", "close", 50)}, 0) AS cv FROM a1),
b1 AS (SELECT *, {lag("pm")} AS pm1, {lag("cv")} AS cv1, {lag("ret")} AS ret1, {lag("sar_fast")} AS sf1, {lag("close")} AS c1, {lag("rsi")} AS rsi1, {lag("macd_hist")} AS hist1, {lag("macd")} AS macd1, {lag("smi")} AS smi1, {lag("smi")} - {lag("smi_signal")} AS gap1 FROM b0)"""
ORACLES["g06_g12_recursive_scores"] = f"WITH {SCORED} SELECT symbol, ts, {', '.join(f'round({e}, 6) + 0.0::DOUBLE AS {n}' for n, e in _RECURSIVE_SCORES.items())} FROM b1"

_FLOW = HOURLY + f""", tp AS (SELECT *, (high + low + close) / 3 AS t FROM bars), mf AS (SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN t > p THEN t * volume ELSE 0 END END AS u, CASE WHEN p IS NOT NULL THEN CASE WHEN t < p THEN t * volume ELSE 0 END END AS d FROM (SELECT *, {lag("t")} AS p FROM tp)),
mi AS (SELECT *, CASE WHEN dn = 0 AND un > 0 THEN 100 ELSE 100 - 100 / (1 + un / nullif(dn, 0)) END AS mfi FROM (SELECT *, {roll("sum", "u", 14)} AS un, {roll("sum", "d", 14)} AS dn FROM mf))"""
_MFI = _score([(0.35, "(mfi - 50) / 50"), (0.25, f"(mfi - {lag('mfi')}) / 100"), (0.2, "CASE WHEN mfi >= 80 THEN -(mfi - 80) / 20 WHEN mfi <= 20 THEN (20 - mfi) / 20 ELSE 0 END"), (0.2, _maybe(f"((mfi - {lag('mfi', 9)}) / 100 - {_change('close', 10)}) * 5"))])
ORACLES["g13_money_flow_score"] = f"WITH {_FLOW} SELECT symbol, ts, round({_MFI}, 6) + 0.0::DOUBLE AS mfi_score FROM mi"
#: The simpler band around zero: in above 0.3, kept until inside 0.1.
_BAND = "CASE WHEN {was} > 0 AND b.score >= 0.1 OR {was} < 0 AND b.score <= -0.1 THEN {was} WHEN b.score >= 0.3 THEN 1 WHEN b.score <= -0.3 THEN -1 ELSE 0 END"
ORACLES["g31_hysteresis_regime"] = f"""WITH RECURSIVE {HOURLY}, y AS (SELECT symbol, seq, tanh((close - 50) / 50) AS score FROM seqs), h AS (
  SELECT symbol, seq, {_BAND.format(was="0")} AS regime FROM y b WHERE seq = 1 UNION ALL SELECT b.symbol, b.seq, {_BAND.format(was="h.regime")} FROM h JOIN y b ON b.symbol = h.symbol AND b.seq = h.seq + 1)
SELECT symbol, regime::DOUBLE AS regime, count(*) AS n FROM h GROUP BY ALL"""

_W60 = "OVER (ORDER BY ts ROWS 59 PRECEDING)"
_SYM = {"a": "click", "b": "error", "c": "view"}
#: The largest eigenvalue of a symmetric 3 x 3 matrix in closed form; rows with a missing price count for nothing.
ORACLES["w44_diversification"] = f"""WITH {HOURLY}, p AS (SELECT ts, {", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {k}" for k, s in _SYM.items())} FROM bars GROUP BY ts),
o AS (SELECT ts, {", ".join(f"CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN {k} - 50 END AS {k}" for k in _SYM)} FROM p),
v AS (SELECT ts, count(a) {_W60} AS n, {", ".join(f"covar_samp({x}, {y}) {_W60} AS {x}{y}" for x, y in ("aa", "bb", "cc", "ab", "ac", "bc"))} FROM o),
q AS (SELECT *, (aa + bb + cc) / 3 AS q FROM v), d AS (SELECT *, sqrt((pow(aa - q, 2) + pow(bb - q, 2) + pow(cc - q, 2) + 2 * (ab * ab + ac * ac + bc * bc)) / 6) AS d FROM q),
r AS (SELECT *, ((aa - q) * ((bb - q) * (cc - q) - bc * bc) - ab * (ab * (cc - q) - bc * ac) + ac * (ab * bc - (bb - q) * ac)) / nullif(2 * d * d * d, 0) AS r FROM d)
SELECT ts, CASE WHEN n >= 2 AND q > 0 THEN round(1 - (q + 2 * d * cos(acos(greatest(-1, least(1, coalesce(r, 0)))) / 3)) / (3 * q), 6) + 0.0::DOUBLE END AS diversification FROM r"""


def _above(c: str, n: int) -> str:
    m = roll("avg", c, n)
    return f"(CASE WHEN {m} = 0 THEN 0 ELSE ({c} - {m}) / {m} END)"


_RANGE = "OVER (PARTITION BY symbol ORDER BY ts ROWS {} PRECEDING)"
_K = "(1 / sqrt(4 * ln(2)))"
_GARCH = _score([
    (0.3, f"tanh({_above('g', 21)} / 0.5)"), (0.25, f"tanh(CASE WHEN count(l5) {_RANGE.format(59)} = 60 THEN corr(g, l5) {_RANGE.format(59)} END / 0.5)"), (0.25, f"tanh({roll('avg', 'sh', 5)} / 0.5)"),
    (0.2, f"tanh(CASE WHEN count(g) {_RANGE.format(9)} = 10 THEN regr_slope(g, seq) {_RANGE.format(9)} END / 0.5)"),
])
_PARKINSON = _score([
    (0.35, f"tanh({_above('pk', 21)} / 0.5)"), (0.25, f"tanh({_above('w', 10)} / 0.5)"), (0.2, "(place - 0.5) * 2"),
    (0.2, " + ".join(f"{k}::DOUBLE * tanh({_above('pk', n)} / 0.5)" for n, k in ((5, 0.5), (10, 0.3), (21, 0.2)))),
])
ORACLES["g16_g17_garch_parkinson_scores"] = f"""WITH {FULL},
c0 AS MATERIALIZED (SELECT symbol, seq, ts, sqrt(garch) AS g, ret, high - low AS w, CASE WHEN high > 0 AND low > 0 THEN {_K} * abs(ln(high / low)) END AS pk FROM a1),
rk AS (SELECT a.symbol, a.seq, count(*) FILTER (b.w <= a.w) / count(*) AS place FROM c0 a JOIN c0 b ON a.symbol = b.symbol AND b.seq <= a.seq GROUP BY ALL),
c1 AS (SELECT c0.*, place, {lag("g", 5)} AS l5, abs(ret / nullif(g, 0)) AS sh FROM c0 JOIN rk USING (symbol, seq))
SELECT symbol, ts, round({_GARCH}, 6) + 0.0::DOUBLE AS garch_score, round({_PARKINSON}, 6) + 0.0::DOUBLE AS parkinson_score FROM c1"""

_EVER = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _part(c: str) -> str:
    return f"(CASE WHEN avg({c}) {_EVER} = 0 THEN 0 ELSE {c} / avg({c}) {_EVER} END)"


_YANG_ZHANG = _score([
    (0.3, f"tanh({_above('y', 21)} / 0.5)"), (0.25, f"tanh(({roll('stddev_samp', 'gap', 5)} / nullif(stddev_samp(gap) {_EVER}, 0) - 1) / 0.5)"), (0.25, f"tanh({_above('spread', 10)} / 0.5)"),
    (0.2, f"tanh((({_part('vo')} + {_part('vc')} + {_part('vs')}) / 3 - 1) / 0.5)"),
])
_G18 = HOURLY + f""", y0 AS (SELECT symbol, ts, open, high, low, close, {lag("close")} AS p FROM bars),
y1 AS (SELECT symbol, ts, CASE WHEN open > 0 AND p > 0 THEN ln(open / p) END AS o, CASE WHEN close > 0 AND open > 0 THEN ln(close / open) END AS c,
  CASE WHEN least(open, high, low, close) > 0 THEN ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) END AS s, (open - p) / nullif(p, 0) AS gap, (high - low) / nullif(open, 0) AS spread FROM y0),
y2 AS (SELECT *, {roll("var_samp", "o", 21)} AS vo, {roll("var_samp", "c", 21)} AS vc, {roll("avg", "s", 21)} AS vs FROM y1),
y3 AS (SELECT *, CASE WHEN vo + 0.34::DOUBLE * vc + 0.66::DOUBLE * vs >= 0 THEN sqrt(vo + 0.34::DOUBLE * vc + 0.66::DOUBLE * vs) END AS y FROM y2)"""


@query(f"WITH {_G18} SELECT symbol, ts, round({_YANG_ZHANG}, 5) + 0.0::DOUBLE AS yang_zhang_score FROM y3")
def g18_yang_zhang_score(s, d):
    from ..operators import scores

    return rounded(scores.yang_zhang_score(schema.bars(s, d)).select("symbol", "ts", "yang_zhang_score"), 5)
