"""Registered queries on feature sets, files and the covariance stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import features, recursive
from ..sources import files
from ..sources.shared import new_folder
from ..streaming import jobs
from .sql import CENTS, HOURLY, lag, roll, rounded, select

QUERIES, ORACLES = {}, {}


def query(text=None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


def _c(s, d):
    return schema.in_cents(schema.bars(s, d))


K = "symbol, ts"
ALL = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _so_far(c):
    return f"list({c}) {ALL}"


def _ema(values, n):
    """The exponential mean of a list, seeded with its first value."""
    a = f"(2.0::DOUBLE / {n + 1})"
    return f"list_reduce({values}, lambda e, x: {a} * x + (1 - {a}) * e)"


def _seeded(values, n, step):
    """The same seeded with the mean of the first n values, null before."""
    return f"CASE WHEN len({values}) >= {n} THEN list_reduce(list_prepend(list_sum({values}[1:{n}]) / {n}, {values}[{n + 1}:]), lambda e, x: {step}) END"


def _known(c):
    return f"last_value({c} IGNORE NULLS) {ALL}"


_G, _L = "CASE WHEN ret IS NOT NULL THEN greatest(ret, 0) END", "CASE WHEN ret IS NOT NULL THEN greatest(-ret, 0) END"
_M20, _S20 = roll("avg", "close", 20), roll("stddev_samp", "close", 20)
_W50 = CENTS + (
    f", m0 AS (SELECT *, {_so_far('close')} AS l FROM rets), m1 AS (SELECT *, {_ema('l', 12)} - {_ema('l', 26)} AS macd FROM m0), m2 AS (SELECT *, {_so_far('macd')} AS k FROM m1), "
    f"m3 AS (SELECT *, {_ema('k', 9)} AS macd_signal, {roll('avg', _G, 14)} AS g, {roll('avg', _L, 14)} AS o FROM m2), "
    f"m4 AS (SELECT symbol, ts, ret AS \"return\", {roll('stddev_samp', 'ret', 14)} AS volatility, {roll('avg', 'ret', 14)} AS momentum, close / nullif({roll('avg', 'close', 14)}, 0) AS price_to_sma, {roll('stddev_samp', 'close', 14)} AS price_std, "
    f"CASE WHEN o = 0 AND g > 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(o, 0)) END AS rsi, macd, macd_signal, (close - ({_M20} - 2 * {_S20})) / nullif(4 * {_S20}, 0) AS bb_position, {roll('skewness', 'ret', 14)} AS skewness, {roll('kurtosis', 'ret', 14)} AS kurtosis FROM m3), "
    "m5 AS (SELECT symbol, ts, " + ", ".join(f'{_known(chr(34) + c + chr(34))} AS "{c}"' for c in features.STANDARD) + " FROM m4)"
)


@query(select(_W50, "m5", K, 4, where="WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in features.STANDARD), **{f'"{c}"': f'"{c}"' for c in features.STANDARD}))
def w50_standard_features(s, d):
    return rounded(features.standard_features(_c(s, d)), 4)


_WILDER, _E = "(e * 13 + x) / 14", "(2.0::DOUBLE / {0}) * x + (1 - 2.0::DOUBLE / {0}) * e"
_P20 = roll("stddev_pop", "close", 20)
_W51 = CENTS + (
    f", f0 AS (SELECT *, close - {lag('close')} AS dd, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, {_so_far('close')} AS l FROM rets), "
    f"f1 AS (SELECT *, {_ema('l', 12)} - {_ema('l', 26)} AS macd, {_so_far('greatest(dd, 0)')} AS gs, {_so_far('greatest(-dd, 0)')} AS ls, {_so_far('tr')} AS ts_, CASE WHEN dd IS NULL THEN volume ELSE sign(dd) * volume END AS ob FROM f0), "
    f"f2 AS (SELECT *, {_so_far('macd')} AS k, {_seeded('gs[2:]', 14, _WILDER)} AS g, {_seeded('ls[2:]', 14, _WILDER)} AS o, {_seeded('ts_[2:]', 14, _WILDER)} AS atr FROM f1), "
    f"f3 AS (SELECT symbol, ts, n, open, high, low, close, volume, {', '.join(f'{_seeded("l", n, _E.format(n + 1))} AS ema_{n}' for n in (5, 10, 20))}, CASE WHEN o = 0 THEN 100 ELSE 100 - 100 / (1 + g / o) END AS rsi_14, macd, {_ema('k', 9)} AS macd_signal, macd - {_ema('k', 9)} AS macd_hist, atr, "
    f"{', '.join(f'{roll("avg", "close", n)} AS sma_{n}' for n in (5, 10, 20, 50))}, {_M20} AS bb_mid, {_M20} + 2 * {_P20} AS bb_up, {_M20} - 2 * {_P20} AS bb_low, 4 * {_P20} / nullif({_M20}, 0) AS bb_width, sum(ob) {ALL} AS obv, {roll('avg', 'volume', 5)} AS volume_sma_5, coalesce(volume / nullif({roll('avg', 'volume', 5)}, 0), 0) AS volume_ratio_5, "
    f"{', '.join(f'close / nullif({roll("avg", "close", n)}, 0) - 1 AS price_to_sma_{n}' for n in (5, 20, 50))}, {', '.join(f'close / nullif({lag("close", n)}, 0) - 1 AS return_{n}' for n in (1, 3, 5))}, {', '.join(f'{roll("stddev_samp", "ret", n)} AS volatility_{n}' for n in (5, 10))} FROM f2)"
)
_F51 = [*(f"ema_{n}" for n in (5, 10, 20)), "rsi_14", "macd", "macd_signal", "macd_hist", "atr", *(f"sma_{n}" for n in (5, 10, 20, 50)), "bb_mid", "bb_up", "bb_low", "bb_width", "obv", "volume_sma_5", "volume_ratio_5", *(f"price_to_sma_{n}" for n in (5, 20, 50)), *(f"return_{n}" for n in (1, 3, 5)), "volatility_5", "volatility_10"]


@query(select(_W51, "f3", K, 4, where="WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _F51), **{c: c for c in _F51}))
def w51_feature_pipeline(s, d):
    return rounded(features.feature_pipeline(_c(s, d)).select("symbol", "ts", *_F51), 4)


@query()
def w08_ema_grid(s, d):
    return rounded(recursive.ema_grid(schema.bars(s, d)).drop("open", "high", "low", "close", "volume", "n"), 6)


def _as_klines(x):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    none = F.lit("0")
    return x.select(ms.alias("open_time"), "open", "high", "low", "close", "volume", (ms + 3_599_999).alias("close_time"), none.alias("quote_volume"), F.col("n").alias("trades"), none.alias("taker_base"), none.alias("taker_quote"), none.alias("ignore"))


def _by_symbol(s, x, folder, name):
    """Writes a CSV folder for each symbol; symbols are the few kinds of events."""
    for r in x.select("symbol").distinct().collect():
        _as_klines(x.where(F.col("symbol") == r["symbol"])).write.option("header", True).mode("overwrite").csv(f"{folder}/{name.format(r['symbol'])}")


@query(f"WITH {HOURLY} SELECT symbol, '1h' AS timeframe, ts, open, high, low, close, volume, n AS trades FROM bars")
def s01_read_klines(s, d):
    at = new_folder(s, "klines")
    _by_symbol(s, schema.bars(s, d), at, "{}_1h.csv")
    return files.read_klines(s, f"{at}/*_1h.csv").select("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", "trades")


@query(f"WITH {HOURLY} SELECT symbol, '1h' AS timeframe, close, n AS trades FROM bars")
def s03_read_latest(s, d):
    at, x = new_folder(s, "versions"), schema.bars(s, d)
    _by_symbol(s, x.withColumn("close", F.col("close") * 2), at, "{}_1h_20240101.csv")
    _by_symbol(s, x, at, "{}_1h_20240201.csv")
    return files.read_latest(s, f"{at}/*.csv", schema.KLINE).select("symbol", "timeframe", F.col("close").cast("double").alias("close"), "trades")


@query(f"WITH {HOURLY}, m AS (SELECT symbol, max(close) AS best FROM bars GROUP BY symbol) SELECT symbol, ts, close, best FROM bars JOIN m USING (symbol)")
def s05_write_results(s, d):
    at, x = new_folder(s, "results"), schema.bars(s, d).select("symbol", "ts", "close")
    files.write_results(at, curve=x, metrics=x.groupBy("symbol").agg(F.max("close").alias("best")))
    return s.read.parquet(f"{at}/curve").join(s.read.schema("symbol string, best double").json(f"{at}/metrics"), "symbol").select("symbol", "ts", "close", "best")


_R5 = HOURLY + f", b AS (SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTES), k AS (SELECT * FROM b WHERE ts > (SELECT max(ts) FROM b) - INTERVAL 48 HOURS), r AS (SELECT symbol, ts, close / nullif({lag('close')}, 0) - 1 AS r FROM k)"


@query(select(_R5, "r a JOIN r b ON a.ts = b.ts AND a.symbol <= b.symbol AND a.r IS NOT NULL AND b.r IS NOT NULL", "a.symbol AS sym1, b.symbol AS sym2, count(*) AS n", 4, where="GROUP BY a.symbol, b.symbol", cov="covar_samp(a.r, b.r)"))
def r05_covariance_sink(s, d):
    return rounded(_last_epoch(s, f"{_sunk(s, d)}/cov").select("sym1", "sym2", "cov", "n"), 4)


@query(select(_R5, "k", "ts", 4, where="WHERE symbol IN ('click', 'view') GROUP BY ts", value="sum(close * CASE symbol WHEN 'click' THEN 1 ELSE 2 END)"))
def r05_portfolio_value(s, d):
    x = _last_epoch(s, f"{_sunk(s, d)}/value")
    return rounded(x.where("value is not null").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "value"), 4)


def _last_epoch(s, path):
    x = s.read.parquet(path)
    return x.join(F.broadcast(x.agg(F.max("epoch").alias("epoch"))), "epoch")  # one row


def _sunk(s, d):
    """Runs bars of the events through the sink and gives its folder."""
    at = new_folder(s, "r05")
    e = s.read.parquet(f"{d}/events.parquet")
    x = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    ticks = x.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    sink = jobs.covariance_sink(f"{at}/out", 48, {"click": 1.0, "view": 2.0})
    q = jobs.stream_bars(ticks, "1 hour").writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{at}/out"
