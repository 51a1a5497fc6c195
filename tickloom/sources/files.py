"""Reading and writing bars, fundamentals, funding rates, messages and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KLINE


def read_klines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Kline CSV files named <symbol>_<timeframe>.csv below path as one table, typed as in S2."""
    x = spark.read.schema(KLINE).option("header", header).csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)_([0-9]+[a-zA-Z]+)[^/]*\.csv", 1)
    frame = F.regexp_extract(F.input_file_name(), r"([^/]+?)_([0-9]+[a-zA-Z]+)[^/]*\.csv", 2)
    return type_klines(x.withColumns({"symbol": name, "timeframe": frame}))


def type_klines(x: DataFrame) -> DataFrame:
    """Times from epoch milliseconds, numbers from strings; what doesn't parse is null."""
    num = lambda c: F.expr(f"try_cast({c} as double)").alias(c)
    ms = lambda c: F.timestamp_millis(F.col(c)).cast("timestamp_ntz")
    rest = [c for c in x.columns if c not in KLINE.fieldNames()]
    return x.select(*rest, ms("open_time").alias("ts"), *(num(c) for c in ("open", "high", "low", "close", "volume")), ms("close_time").alias("close_time"), num("quote_volume"), "trades", num("taker_base"), num("taker_quote"))


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: of files named <symbol>_<timeframe>_<date>.csv the last by name for each symbol and timeframe, lower-case columns.

    The choice is a grouped maximum over file names; rows of other files are dropped by a join on the name.
    """
    x = spark.read.schema(schema).option("header", True).csv(path).withColumn("_f", F.input_file_name())
    part = lambda i: F.regexp_extract("_f", r"([^/_]+)_([^/_]+)_([^/]+)\.csv", i)
    x = x.withColumns({"symbol": part(1), "timeframe": part(2), "_d": part(3)})
    last = x.groupBy("symbol", "timeframe").agg(F.max("_d").alias("_d"))
    x = x.join(last, ["symbol", "timeframe", "_d"]).drop("_f", "_d")
    return x.toDF(*(c.lower() for c in x.columns))


def write_cache(bars: DataFrame, path: str) -> DataFrame:
    """Writes bars by symbol and timeframe, which later reads prune by; returns the metadata."""
    bars.write.mode("overwrite").partitionBy("symbol", "timeframe").parquet(path)
    return cache_metadata(bars)


def cache_metadata(bars: DataFrame) -> DataFrame:
    """First and last time and number of records of each symbol and timeframe."""
    return bars.groupBy("symbol", "timeframe").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("records"))


def read_cache(spark: SparkSession, path: str, symbols: list[str] | None = None, timeframe: str | None = None) -> DataFrame:
    x = spark.read.parquet(path)
    if symbols is not None:
        x = x.where(F.col("symbol").isin(symbols))
    return x.where(F.col("timeframe") == timeframe) if timeframe is not None else x


def write_results(path: str, **tables: DataFrame) -> None:
    """Each table below path: trades and curves as Parquet, `metrics` as JSON."""
    for name, x in tables.items():
        x.write.mode("overwrite").format("json" if name == "metrics" else "parquet").save(f"{path}/{name}")


def flatten_history(history: DataFrame) -> DataFrame:
    """Date, symbol, shares, price, value, sector, total of nested history (date, total_value, positions map)."""
    x = history.select("date", "total_value", F.explode("positions").alias("symbol", "p"))
    return x.select("date", "symbol", F.col("p.shares").alias("shares"), F.col("p.price").alias("price"), F.col("p.value").alias("value"), F.col("p.sector").alias("sector"), F.col("total_value").alias("total"))


#: What stands in for a missing figure.
FUNDAMENTAL_DEFAULTS = {"market_cap": 0.0, "profit_margin": 0.0, "debt_to_equity": float("inf"), "roic": 0.0, "dividend_yield": 0.0, "beta": 1.0, "current_price": 0.0}


def fundamentals(x: DataFrame) -> DataFrame:
    """Fundamentals with their defaults; text columns default to Unknown."""
    num = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in FUNDAMENTAL_DEFAULTS.items() if c in x.columns}
    text = {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("name", "sector") if c in x.columns}
    return x.withColumns(num | text)


def funding_rates(x: DataFrame) -> DataFrame:
    """Typed funding history (symbol, fundingTime in ms, fundingRate as text)."""
    return x.select("symbol", F.timestamp_millis("fundingTime").cast("timestamp_ntz").alias("ts"), F.expr("try_cast(fundingRate as double)").alias("rate"))


MESSAGE = T.StructType([T.StructField("data", T.StructType([T.StructField("e", T.StringType()), T.StructField("s", T.StringType()), T.StructField("p", T.StringType()), T.StructField("E", T.LongType())]))])


def decode_messages(x: DataFrame, column: str = "value") -> DataFrame:
    """Symbol, price and event time of mark-price messages; other events and broken JSON are dropped. Batch or stream."""
    kind, sym, price, at = (F.get_json_object(F.col(column).cast("string"), f"$.data.{k}") for k in ("e", "s", "p", "E"))
    y = x.select(kind.alias("event"), sym.alias("symbol"), price.try_cast("double").alias("price"), F.timestamp_millis(at.try_cast("bigint")).alias("ts"))
    return y.where((F.col("event") == "markPriceUpdate") & F.col("symbol").isNotNull() & F.col("price").isNotNull())


