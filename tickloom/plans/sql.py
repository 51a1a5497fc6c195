"""Small pieces of SQL text for the comparison queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURLY = """
t AS (SELECT event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS volume FROM events),
bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
  sum(volume) AS volume, count(*) AS n FROM t GROUP BY symbol, date_trunc('hour', ts)),
seqs AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS seq FROM bars),
rets AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM seqs)"""
#: The same bars with prices in whole cents, see schema.in_cents.
CENTS = HOURLY.replace("value AS price", "round(value * 100) AS price")
DAILY = """
d AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS close FROM orders GROUP BY ALL)"""
LEDGER = """
ledger AS (SELECT l_suppkey AS portfolio, l_partkey AS symbol, l_shipdate AS ts, l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty, l_extendedprice / l_quantity AS price,
  l_extendedprice * (l_discount - 0.05::DOUBLE) AS pnl, l_extendedprice * 0.0004::DOUBLE AS commission FROM lineitem)"""
PAIRS = HOURLY + """,
pb AS (SELECT a.symbol AS sym1, b.symbol AS sym2, a.ts, a.close AS close1, b.close AS close2 FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol),
pr AS (SELECT *, close1 / nullif(lag(close1) OVER w, 0) - 1 AS ret1, close2 / nullif(lag(close2) OVER w, 0) - 1 AS ret2 FROM pb WINDOW w AS (PARTITION BY sym1, sym2 ORDER BY ts))"""


def over(n: int, key: str = "symbol", end: int = 0) -> str:
    last = "CURRENT ROW" if not end else f"{-end} PRECEDING"
    return f"OVER (PARTITION BY {key} ORDER BY ts ROWS BETWEEN {n - 1 - end} PRECEDING AND {last})"


def roll(f: str, c: str, n: int, key: str = "symbol", end: int = 0) -> str:
    """f over the last n values of c, null unless there are n."""
    w = over(n, key, end)
    return f"(CASE WHEN count({c}) {w} = {n} THEN {f}({c}) {w} END)"


def lag(c: str, k: int = 1, key: str = "symbol") -> str:
    return f"lag({c}, {k}) OVER (PARTITION BY {key} ORDER BY ts)"


def so_far(f: str, c: str, key: str = "symbol") -> str:
    return f"{f}({c}) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def select(with_: str, source: str, keys: str, digits: int = 6, where: str = "", **columns: str) -> str:
    """SELECT keys and rounded columns."""
    cols = ", ".join(f"round({e}, {digits}) + 0.0::DOUBLE AS {n}" for n, e in columns.items())
    return f"WITH {with_} SELECT {keys}{', ' if cols else ''}{cols} FROM {source} {where}"


def rounded(x: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, without negative zeros."""
    return x.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes))


def nearest(c: str, digits: int) -> Column:
    """c rounded as DuckDB rounds: the scaled double, halves away from 0. F.round goes through decimal text, which costs more than all else of a row."""
    x = F.abs(c) * 10.0**digits + 0.5
    return (F.signum(c) * (x - x % 1.0) / 10.0**digits + 0.0).alias(c)
