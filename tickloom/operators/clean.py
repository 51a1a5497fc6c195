"""Projections, filters and cleaning of bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import last_known, next_known
from .prefix import numbered


def drop_duplicate_times(bars: DataFrame, order: str = "ingest") -> DataFrame:
    """The first row, by `order`, of each (symbol, ts)."""
    w = Window.partitionBy("symbol", "ts").orderBy(order)
    return bars.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def forward_fill(bars: DataFrame, columns: list[str]) -> DataFrame:
    """The last known value of each column within its symbol."""
    return bars.withColumns({c: last_known(c) for c in columns})


def fill_all(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Forward, then backward, then 0."""
    return bars.withColumns({c: F.coalesce(last_known(c), next_known(c), F.lit(0.0)) for c in columns})


def drop_warm_up(x: DataFrame, features: list[str]) -> DataFrame:
    """Rows with all features present."""
    return x.dropna(subset=features)


def finite(c: Column, limit: float | None = None) -> Column:
    """P5: NaN becomes null; infinities become null, or plus or minus `limit` if given."""
    inf = F.lit(float("inf"))
    out = F.when(F.isnan(c), None).when(c == inf, F.lit(limit)).when(c == -inf, F.lit(None if limit is None else -limit)).otherwise(c)
    return out.cast("double")


def validate(bars: DataFrame) -> DataFrame:
    """Per symbol the rows, nulls and infinities in the price and volume columns, and whether all is well."""
    cols = ["open", "high", "low", "close", "volume"]
    missing = [c for c in cols if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    count = lambda f: sum(F.sum(F.when(f(F.col(c)), 1).otherwise(0)) for c in cols)
    x = bars.groupBy("symbol").agg(F.count("*").alias("n"), count(F.isnull).alias("n_null"), count(lambda c: F.isnan(c) | (F.abs(c) == float("inf"))).alias("n_inf"))
    return x.withColumn("ok", (F.col("n_null") == 0) & (F.col("n_inf") == 0) & (F.col("n") > 0))


def complete_enough(bars: DataFrame, expected: int, share: float = 0.9) -> DataFrame:
    """Bars of the symbols that have at least this share of the expected bars."""
    good = bars.groupBy("symbol").count().where(F.col("count") >= share * expected).select("symbol")
    return bars.join(good, "symbol", "left_semi")


def screen_universe(quotes: DataFrame, suffix: str = "USDT", status: str = "TRADING", min_volume: float = 0.0, max_spread: float = 0.001) -> DataFrame:
    """Symbols by name, status, quote volume and relative spread (ask - bid) / bid. quotes: symbol, status, quote_volume, ask, bid."""
    x = quotes.withColumn("spread", (F.col("ask") - F.col("bid")) / F.nullif("bid", F.lit(0.0)))
    return x.where(F.col("symbol").endswith(suffix) & (F.col("status") == status) & (F.col("quote_volume") >= min_volume) & (F.col("spread") <= max_spread))


def between(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Start <= ts < end; reaches the scan as a pushed filter."""
    return bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def last_hours(bars: DataFrame, hours: int) -> DataFrame:
    """The last hours of each symbol, counted back from its own last bar."""
    end = bars.groupBy("symbol").agg(F.max("ts").alias("_end"))
    return bars.join(end, "symbol").where(F.col("ts") > F.col("_end") - F.expr(f"INTERVAL {int(hours)} HOURS")).drop("_end")


def split_by_time(bars: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """P10: `part` (train, validation or test) by position on the calendar of all symbols.

    The calendar, distinct times, is numbered by ranges, so no task gets all of it.
    """
    cal = numbered(bars.select("ts").distinct(), ["ts"], "i", "n")
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + validation))
    cal = cal.select("ts", F.when(F.col("i") < a, "train").when(F.col("i") < b, "validation").otherwise("test").alias("part"))
    return bars.join(cal, "ts")


def three_periods(bars: DataFrame) -> DataFrame:
    """`period` 0, 1 or 2 of equal length between the latest first and the earliest last day of the symbols."""
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).agg(F.to_date(F.max("a")).alias("start"), F.to_date(F.min("b")).alias("stop"))
    x = bars.join(F.broadcast(ends), F.to_date("ts").between(F.col("start"), F.col("stop")))  # one row
    third = F.expr("(datediff(stop, start) + 1) div 3")
    return x.withColumn("period", F.least(F.lit(2), F.floor(F.datediff(F.to_date("ts"), "start") / F.greatest(third, F.lit(1)))).cast("int")).drop("start", "stop")


def flip(bars: DataFrame, decimals: int = 2) -> DataFrame:
    """Prices mirrored about the symbol's highest high and lowest low; high and low change places."""
    ends = bars.groupBy("symbol").agg((F.max("high") + F.min("low")).alias("_s"))
    x = bars.join(ends, "symbol")
    m = lambda c: F.round(F.col("_s") - F.col(c), decimals)
    x = x.withColumns({"open": m("open"), "high": m("low"), "low": m("high"), "close": m("close")}).drop("_s")
    ok = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return x.withColumn("valid", ok)


def decimals(c: str) -> Column:
    """Aggregate: the most decimal places of a numeric column."""
    part = F.regexp_extract(F.col(c).cast("decimal(38,12)").cast("string"), r"\.(\d*?)0*$", 1)
    return F.max(F.length(part))


def epoch_ms(ts: str) -> Column:
    """Milliseconds since the epoch, UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def from_epoch_ms(ms: str) -> Column:
    """The UTC time of epoch milliseconds."""
    return F.timestamp_millis(F.col(ms)).cast("timestamp_ntz")


def by_mean(c: str, key: str = "symbol") -> Column:
    """A column over its mean per symbol."""
    return F.col(c) / F.nullif(F.avg(c).over(Window.partitionBy(key)), F.lit(0.0))


def min_max(x: DataFrame, c: str, reverse: bool = False, out: str = "scaled") -> DataFrame:
    """Scaled to [0, 1] over all rows, reversed on demand; a constant column gives 0.5."""
    ends = x.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    v = (F.col(c) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    v = F.coalesce(1 - v if reverse else v, F.when(F.col(c).isNotNull(), 0.5))
    return x.join(F.broadcast(ends), how="cross").withColumn(out, v).drop("_lo", "_hi")  # one row on the right


def winsorise(x: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """Values limited to mean +- k sample deviations of their column."""
    m = x.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    lim = {c: F.greatest(F.least(F.col(c), F.col(f"_m_{c}") + k * F.col(f"_s_{c}")), F.col(f"_m_{c}") - k * F.col(f"_s_{c}")) for c in columns}
    return x.join(F.broadcast(m), how="cross").withColumns(lim).select(*x.columns)  # one row on the right


def calendar(ts: str) -> list[Column]:
    """Day of week (Monday 0) and hour."""
    return [F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")]
