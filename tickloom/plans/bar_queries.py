"""Registered queries on bars, cleaning and alignment, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import rolling as R
from ..operators import align, clean
from ..sources import files
from . import sql
from .sql import HOURLY, PAIRS, rounded, select

QUERIES, ORACLES = {}, {}


def query(text: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


def _bars(s: SparkSession, d: str) -> DataFrame:
    return schema.bars(s, d)


def _gappy(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars whose close is missing where the number of ticks is divisible by 3."""
    return _bars(s, d).withColumn("close", F.when(F.col("n") % 3 != 0, F.col("close")))


GAPPY = HOURLY + ", gappy AS (SELECT * REPLACE (CASE WHEN n % 3 <> 0 THEN close END AS close) FROM bars)"


@query(f"WITH {HOURLY} SELECT symbol, ts, open, high, low, close, volume, n FROM bars")
def a12_hourly_bars(s, d):
    return _bars(s, d)


@query(f"WITH {HOURLY} SELECT symbol, date_trunc('day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, date_trunc('day', ts)")
def a13_daily_from_hourly(s, d):
    return schema.resample(_bars(s, d), "day")


@query(
    "WITH e AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, value AS price, event_id AS ingest FROM events) "
    "SELECT symbol, ts, price, ingest FROM e QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest) = 1"
)
def p01_first_of_duplicate_times(s, d):
    e = schema.table(s, d, "events")
    x = e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("ingest"))
    return clean.drop_duplicate_times(x, "ingest")


@query(
    f"WITH {GAPPY} SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS filled, "
    "coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled_all FROM gappy"
)
def p02_p03_fill(s, d):
    x = _gappy(s, d)
    y = clean.fill_all(x, ["close"]).select("symbol", "ts", F.col("close").alias("filled_all"))
    return clean.forward_fill(x, ["close"]).select("symbol", "ts", F.col("close").alias("filled")).join(y, ["symbol", "ts"])


@query(select(GAPPY, f"(SELECT *, {sql.roll('avg', 'close', 3)} AS m, {sql.lag('close')} AS p FROM gappy)", "symbol, ts", where="WHERE m IS NOT NULL AND p IS NOT NULL", m="m", p="p"))
def p04_drop_warm_up(s, d):
    x = _gappy(s, d).select("symbol", "ts", R.sma("close", 3).alias("m"), R.lag("close").alias("p"))
    return rounded(clean.drop_warm_up(x, ["m", "p"]))


@query("SELECT event_id, CASE WHEN value < 20 THEN NULL WHEN value < 40 THEN 1e9 WHEN value < 60 THEN -1e9 ELSE value END AS limited, CASE WHEN value < 60 THEN NULL ELSE value END AS plain FROM events")
def p05_finite(s, d):
    e = schema.table(s, d, "events")
    odd = F.when(F.col("value") < 20, F.lit(float("nan"))).when(F.col("value") < 40, F.lit(float("inf"))).when(F.col("value") < 60, F.lit(float("-inf"))).otherwise(F.col("value"))
    x = e.select("event_id", odd.alias("v"))
    return x.select("event_id", clean.finite(F.col("v"), 1e9).alias("limited"), clean.finite(F.col("v")).alias("plain"))


@query(f"WITH {GAPPY} SELECT symbol, count(*) AS n, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null, 0::BIGINT AS n_inf, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) = 0 AS ok FROM gappy GROUP BY symbol")
def p06_validate(s, d):
    return clean.validate(_gappy(s, d))


@query("WITH b AS (SELECT user_id::VARCHAR AS symbol, date_trunc('day', ts) AS ts, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM b WHERE symbol IN (SELECT symbol FROM b GROUP BY symbol HAVING count(*) >= 0.9 * 28)")
def p07_complete_symbols(s, d):
    x = schema.bars(s, d, "day", "user_id").select("symbol", "ts", "n")
    return clean.complete_enough(x, 28)


@query("SELECT * FROM (SELECT s_name AS symbol, CASE WHEN s_suppkey % 4 = 0 THEN 'HALTED' ELSE 'TRADING' END AS status, s_acctbal AS quote_volume, (100.0 + s_suppkey % 7 * 0.02)::DOUBLE AS ask, 100.0::DOUBLE AS bid, round((s_suppkey % 7 * 0.02) / 100.0, 6) + 0.0::DOUBLE AS spread FROM supplier) WHERE symbol LIKE '%5' AND status = 'TRADING' AND quote_volume >= 0 AND spread <= 0.001")
def p08_universe(s, d):
    x = schema.table(s, d, "supplier").select(
        F.col("s_name").alias("symbol"), F.when(F.col("s_suppkey") % 4 == 0, "HALTED").otherwise("TRADING").alias("status"), F.col("s_acctbal").alias("quote_volume"),
        (F.lit(100.0) + F.col("s_suppkey") % 7 * 0.02).alias("ask"), F.lit(100.0).alias("bid"),
    )
    return rounded(clean.screen_universe(x, "5", "TRADING", 0.0, 0.001000001))


@query(f"WITH {HOURLY} SELECT symbol, ts, close, 'range' AS slice FROM bars WHERE ts >= '2024-01-05' AND ts < '2024-01-07' UNION ALL SELECT symbol, ts, close, 'last' FROM bars WHERE ts > (SELECT max(ts) FROM bars b WHERE b.symbol = bars.symbol) - INTERVAL 48 HOURS")
def p09_slices(s, d):
    x = _bars(s, d).select("symbol", "ts", "close")
    return clean.between(x, "2024-01-05", "2024-01-07").withColumn("slice", F.lit("range")).union(clean.last_hours(x, 48).withColumn("slice", F.lit("last")))


@query(f"WITH {HOURLY}, c AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)) SELECT symbol, ts, close, CASE WHEN i < floor(c.n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(c.n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS part FROM bars JOIN c USING (ts)")
def p10_split(s, d):
    return clean.split_by_time(_bars(s, d).select("symbol", "ts", "close")).select("symbol", "ts", "close", "part")


@query(f"WITH {HOURLY}, e AS (SELECT max(a)::DATE AS start, min(b)::DATE AS stop FROM (SELECT min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol)) SELECT symbol, ts, close, least(2, (ts::DATE - start) // greatest(1, (stop - start + 1) // 3))::INT AS period FROM bars, e WHERE ts::DATE BETWEEN start AND stop")
def p11_three_periods(s, d):
    return clean.three_periods(_bars(s, d).select("symbol", "ts", "close"))


@query(
    f"WITH {HOURLY}, e AS (SELECT symbol, max(high) + min(low) AS s FROM bars GROUP BY symbol), f AS (SELECT symbol, ts, round(s - open, 2) AS open, round(s - low, 2) AS high, round(s - high, 2) AS low, round(s - close, 2) AS close FROM bars JOIN e USING (symbol)) "
    "SELECT symbol, ts, open, high, low, close, low <= least(open, close) AND high >= greatest(open, close) AS valid FROM f"
)
def p12_flip(s, d):
    return clean.flip(_bars(s, d).select("symbol", "ts", "open", "high", "low", "close"))


@query("SELECT event_type AS symbol, max(CASE WHEN value = round(value) THEN 0 WHEN value = round(value, 1) THEN 1 WHEN value = round(value, 2) THEN 2 ELSE 3 END)::INT AS places FROM events GROUP BY event_type")
def p13_decimals(s, d):
    return schema.ticks(s, d).groupBy("symbol").agg(clean.decimals("price").alias("places"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ms, make_timestamp((epoch_us(ts) // 1000) * 1000) AS back, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def p14_epoch(s, d):
    e = schema.table(s, d, "events").withColumn("ms", clean.epoch_ms("ts"))
    return e.select("event_id", "ms", clean.from_epoch_ms("ms").alias("back"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))


@query("SELECT event_id, round(greatest(least(value / 100, 1), -1), 6) + 0.0::DOUBLE AS clamped, round(tanh(value / 50), 6) + 0.0::DOUBLE AS squashed, dayofweek(ts + INTERVAL 6 DAYS)::INT AS weekday, hour(ts)::INT AS hour FROM events")
def p15_p19_squash_and_calendar(s, d):
    e = schema.table(s, d, "events")
    return rounded(e.select("event_id", R.clamp(F.col("value") / 100).alias("clamped"), R.squash(F.col("value"), 50).alias("squashed"), *clean.calendar("ts")))


@query(f"WITH {HOURLY} SELECT symbol, ts, round(close / avg(close) OVER (PARTITION BY symbol), 6) + 0.0::DOUBLE AS scaled FROM bars")
def p16_by_mean(s, d):
    return rounded(_bars(s, d).select("symbol", "ts", clean.by_mean("close").alias("scaled")))


@query("SELECT p_partkey, round(1 - (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) + 0.0::DOUBLE AS scaled FROM part")
def p17_min_max(s, d):
    return rounded(clean.min_max(schema.table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", True).select("p_partkey", "scaled"))


@query("WITH m AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, m + 1.5 * s), m - 1.5 * s), 3) + 0.0::DOUBLE AS l_extendedprice FROM lineitem, m")
def p18_winsorise(s, d):
    return rounded(clean.winsorise(schema.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"], 1.5), 3)


@query(f"WITH {HOURLY} SELECT a.ts, a.close AS close_a, b.close AS close_b FROM bars a JOIN bars b USING (ts) WHERE a.symbol = 'click' AND b.symbol = 'view'")
def j01_align(s, d):
    x = _bars(s, d)
    return align.align(x.where("symbol = 'click'"), x.where("symbol = 'view'"))


@query(f"WITH {HOURLY} SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))")
def j02_common_calendar(s, d):
    return align.common_calendar(_bars(s, d).select("symbol", "ts", "close"))


@query(f"WITH {HOURLY}, g AS (SELECT * FROM (SELECT DISTINCT ts FROM bars), (SELECT DISTINCT symbol FROM bars)) SELECT g.symbol, g.ts, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS close, close IS NULL AS filled FROM g LEFT JOIN bars USING (symbol, ts)")
def j03_union_calendar(s, d):
    return align.union_calendar(_bars(s, d).select("symbol", "ts", "close"))


@query("SELECT a.n_name AS sym1, b.n_name AS sym2 FROM nation a, nation b WHERE a.n_name < b.n_name")
def j04_pairs(s, d):
    return align.pairs(schema.table(s, d, "nation").select(F.col("n_name").alias("symbol")))


@query(f"WITH {PAIRS} SELECT sym1, sym2, ts, close1, close2 FROM pb")
def j05_pair_bars(s, d):
    return align.pair_bars(_bars(s, d))


@query(select(HOURLY + ", m AS (SELECT symbol, avg(close) AS mean, stddev_samp(close) AS std FROM bars GROUP BY symbol)", "m a JOIN m b ON a.symbol < b.symbol", "a.symbol AS sym1, b.symbol AS sym2", mean1="a.mean", std1="a.std", mean2="b.mean", std2="b.std"))
def j06_pair_parameters(s, d):
    x = _bars(s, d)
    m = x.groupBy("symbol").agg(F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"))
    return rounded(align.attach_parameters(align.pairs(x), m))


KINDS = ["click", "error", "login", "purchase", "view"]


@query(f"WITH {HOURLY} SELECT ts, " + ", ".join(f"max(CASE WHEN symbol = '{k}' THEN close END) AS close_{k}" for k in ("click", "view")) + " FROM bars GROUP BY ts")
def j07_wide(s, d):
    return align.widen(_bars(s, d), ["click", "view"])


@query(f"WITH {HOURLY}, w AS (SELECT ts, max(CASE WHEN symbol = 'click' THEN close END) AS click, max(CASE WHEN symbol = 'view' THEN close END) AS view FROM bars GROUP BY ts) SELECT ts, 'close_click' AS symbol, click AS close FROM w UNION ALL SELECT ts, 'close_view', view FROM w")
def j08_long(s, d):
    return align.lengthen(align.widen(_bars(s, d), ["click", "view"]), ["close_click", "close_view"])


@query(select(HOURLY + ", e AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM bars), w AS (SELECT unnest(generate_series(a, b - 2, INTERVAL 1 DAY))::DATE AS win_start FROM e)", "bars JOIN w ON ts::DATE BETWEEN win_start AND win_start + 2", "symbol, win_start, count(*) AS n", where="GROUP BY symbol, win_start", mean="avg(close)"))
def j09_formation_windows(s, d):
    x = align.formation_windows(_bars(s, d), 3)
    return rounded(x.groupBy("symbol", "win_start").agg(F.count("*").alias("n"), F.avg("close").alias("mean")))


@query(select(HOURLY + ", e AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM bars), i AS (SELECT unnest(range(0, (b - a + 1 - 10) // 4)) AS iter, a FROM e), x AS (SELECT symbol, iter::INT AS iter, CASE WHEN ts::DATE - a - iter * 4 < 10 THEN 'formation' ELSE 'test' END AS phase, close FROM bars JOIN i ON ts::DATE - a BETWEEN iter * 4 AND iter * 4 + 13)", "x", "symbol, iter, phase, count(*) AS n", where="GROUP BY ALL", mean="avg(close)"))
def j10_walk_forward(s, d):
    x = align.walk_forward(_bars(s, d), 10, 4)
    return rounded(x.groupBy("symbol", "iter", "phase").agg(F.count("*").alias("n"), F.avg("close").alias("mean")))


@query(f"WITH {HOURLY}, q AS (SELECT event_type AS symbol, ts, event_id FROM events) SELECT q.symbol, q.ts, q.event_id, b.close FROM q ASOF LEFT JOIN bars b ON q.symbol = b.symbol AND q.ts >= b.ts")
def j11_as_of(s, d):
    q = schema.table(s, d, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id")
    return align.as_of(q, _bars(s, d).select("symbol", "ts", "close"), ["close"])


@query(f"WITH {HOURLY} SELECT symbol, arg_max(close, ts) AS close, max(ts) AS as_of FROM bars WHERE ts >= '2024-01-03' AND ts < '2024-01-09' GROUP BY symbol")
def j11_last_in_range(s, d):
    return align.last_in_range(_bars(s, d), "2024-01-03", "2024-01-09")


@query("SELECT DISTINCT c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j12_remaining(s, d):
    return align.remaining(schema.table(s, d, "customer").select(F.col("c_custkey").alias("symbol")), schema.table(s, d, "orders").select(F.col("o_custkey").alias("symbol")))


@query("WITH x AS (SELECT l_partkey AS sym1, l_suppkey AS sym2, min(l_discount) AS p, max(l_tax) AS corr FROM lineitem GROUP BY ALL), y AS (SELECT p, sym1, sym2, unnest([0, 1]) AS leg, unnest([sym1, sym2]) AS symbol FROM x WHERE p < 0.05 AND corr >= 0.03) SELECT symbol, (min([p, sym1, sym2, leg]::DOUBLE[]))[1] AS p FROM y GROUP BY symbol ORDER BY min([p, sym1, sym2, leg]::DOUBLE[]) LIMIT 25")
def j13_cointegrated_symbols(s, d):
    x = schema.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("sym1"), F.col("l_suppkey").alias("sym2")).agg(F.min("l_discount").alias("p"), F.max("l_tax").alias("corr"))
    return align.cointegrated_symbols(x, x.select("sym1", "sym2", "corr"), 0.05, 0.03, 25)


@query("WITH h AS (SELECT DISTINCT l_partkey AS sym1, l_suppkey AS sym2, CASE WHEN l_partkey % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS position FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT DISTINCT l_partkey AS sym1, l_suppkey AS sym2 FROM lineitem WHERE l_returnflag = 'A') SELECT sym1, sym2, coalesce(position, 0.0) AS position, n.sym1 IS NOT NULL AS selected FROM h FULL JOIN n USING (sym1, sym2) WHERE coalesce(position, 0) <> 0 OR n.sym1 IS NOT NULL")
def j14_hold_or_select(s, d):
    x = schema.table(s, d, "lineitem").select(F.col("l_partkey").alias("sym1"), F.col("l_suppkey").alias("sym2"), "l_returnflag")
    held = x.where("l_returnflag = 'R'").select("sym1", "sym2", F.when(F.col("sym1") % 3 == 0, 0.0).otherwise(1.0).alias("position")).distinct()
    return align.hold_or_select(held, x.where("l_returnflag = 'A'").select("sym1", "sym2").distinct())


@query("SELECT (SELECT count(*) FROM labels) AS n_rows, (SELECT count(DISTINCT doc_id) FROM labels) AS n_keys, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown, false AS ok")
def j15_submission(s, d):
    return align.check_submission(schema.table(s, d, "labels"), schema.table(s, d, "documents").select("doc_id"), "doc_id")


@query(f"WITH {GAPPY} SELECT symbol, ts, close FROM gappy WHERE ts IN (SELECT ts FROM gappy GROUP BY ts HAVING count(close) = (SELECT count(DISTINCT symbol) FROM gappy))")
def j16_complete_rows(s, d):
    return align.complete_rows(_gappy(s, d).select("symbol", "ts", "close"), ["close"])


@query("SELECT 'k' || event_type AS symbol, make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts, value AS close, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS volume FROM events")
def s02_typed_klines(s, d):
    e = schema.table(s, d, "events")
    raw = e.select(
        F.concat(F.lit("k"), "event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("open_time"), *(F.col("value").cast("string").alias(c) for c in ("open", "high", "low", "close")),
        F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.col("value").cast("string")).alias("volume"), F.lit(0).cast("long").alias("close_time"), F.lit("1").alias("quote_volume"), F.lit(1).cast("long").alias("trades"), F.lit("1").alias("taker_base"), F.lit("1").alias("taker_quote"),
    )
    return files.type_klines(raw).select("symbol", "ts", "close", "volume")


@query("WITH b AS (SELECT event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN '1h' ELSE '4h' END AS timeframe, ts FROM events) SELECT symbol, timeframe, min(ts) AS start, max(ts) AS end, count(*) AS records FROM b GROUP BY ALL")
def s04_cache_metadata(s, d):
    e = schema.table(s, d, "events").select(F.col("event_type").alias("symbol"), F.when(F.col("user_id") % 2 == 0, "1h").otherwise("4h").alias("timeframe"), "ts")
    return files.cache_metadata(e)


@query("WITH l AS (SELECT l_shipdate AS date, l_partkey::VARCHAR AS symbol, sum(l_quantity) AS shares, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL), t AS (SELECT date, sum(price) AS total FROM l GROUP BY date) SELECT date, symbol, shares, price, shares * price AS value, 'x' AS sector, round(total, 2) + 0.0::DOUBLE AS total FROM l JOIN t USING (date)")
def s06_flat_history(s, d):
    x = schema.table(s, d, "lineitem").groupBy(F.col("l_shipdate").alias("date"), F.col("l_partkey").cast("string").alias("symbol")).agg(F.sum("l_quantity").alias("shares"), F.max("l_extendedprice").alias("price"))
    entry = F.struct("symbol", F.struct("shares", "price", (F.col("shares") * F.col("price")).alias("value"), F.lit("x").alias("sector")).alias("p"))
    h = x.groupBy("date").agg(F.sum("price").alias("total_value"), F.map_from_entries(F.collect_list(entry)).alias("positions"))
    return files.flatten_history(h).withColumn("total", F.round("total", 2) + 0.0)


@query("SELECT p_name AS symbol, CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE p_brand END AS sector, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE p_size / 10.0 END::DOUBLE AS beta, CASE WHEN p_size % 5 = 0 THEN 'inf'::DOUBLE ELSE p_retailprice END AS debt_to_equity FROM part")
def s07_fundamentals(s, d):
    p = schema.table(s, d, "part")
    return files.fundamentals(p.select(
        F.col("p_name").alias("symbol"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("sector"), F.when(F.col("p_size") % 2 != 0, F.col("p_size") / 10.0).alias("beta"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("debt_to_equity"),
    ))


@query("SELECT event_type AS symbol, make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 10000 END AS rate FROM events")
def s08_funding(s, d):
    e = schema.table(s, d, "events")
    return files.funding_rates(e.select(F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("fundingTime"), F.when(F.col("event_id") % 4 == 0, "n/a").otherwise((F.col("value") / 10000).cast("string")).alias("fundingRate")))


@query("SELECT event_type AS symbol, value AS price, make_timestamp((epoch_us(ts) // 1000) * 1000)::TIMESTAMP AS ts FROM events WHERE event_id % 3 <> 0")
def s09_messages(s, d):
    e = schema.table(s, d, "events")
    msg = F.to_json(F.struct(F.struct(F.when(F.col("event_id") % 3 == 0, "other").otherwise("markPriceUpdate").alias("e"), F.col("event_type").alias("s"), F.col("value").cast("string").alias("p"), F.unix_millis(F.col("ts").cast("timestamp")).alias("E")).alias("data")))
    return files.decode_messages(e.select(msg.alias("value"))).select("symbol", "price", F.col("ts").cast("timestamp_ntz").alias("ts"))


