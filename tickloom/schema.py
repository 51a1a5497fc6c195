"""Canonical schemas, and the views of market data that the sample tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

#: A raw kline as exchanges deliver it: times in epoch milliseconds, numbers as strings.
KLINE = T.StructType([
    T.StructField("open_time", T.LongType()),
    T.StructField("open", T.StringType()),
    T.StructField("high", T.StringType()),
    T.StructField("low", T.StringType()),
    T.StructField("close", T.StringType()),
    T.StructField("volume", T.StringType()),
    T.StructField("close_time", T.LongType()),
    T.StructField("quote_volume", T.StringType()),
    T.StructField("trades", T.LongType()),
    T.StructField("taker_base", T.StringType()),
    T.StructField("taker_quote", T.StringType()),
    T.StructField("ignore", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """symbol, ts, price, volume from events. symbol: event_type (few, dense) or user_id (many, sparse)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col(symbol).cast("string").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def to_bars(x: DataFrame, unit: str = "hour") -> DataFrame:
    """OHLCV bars of ticks (symbol, ts, price, volume) by a unit of date_trunc; n is the number of ticks.

    One aggregate with partial sums before the shuffle by (symbol, ts), so a very active symbol is spread by time.
    """
    x = x.withColumn("bar", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    return x.groupBy("symbol", F.col("bar").alias("ts")).agg(
        F.min_by("price", "ts").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("n"),
    )


def resample(bars: DataFrame, unit: str = "day") -> DataFrame:
    """Longer bars from bars."""
    x = bars.withColumn("bar", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    return x.groupBy("symbol", F.col("bar").alias("ts")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str, unit: str = "hour", symbol: str = "event_type") -> DataFrame:
    return to_bars(ticks(spark, sf_dir, symbol), unit)


def in_cents(x: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices as whole numbers of cents. Sums of them are exact whatever their order, so ratios don't depend on the plan."""
    return x.withColumns({c: F.round(F.col(c) * 100) for c in columns})


def daily_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (order priority), ts (day), close (mean order value): a long daily series."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.avg("o_totalprice").alias("close"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger from lineitem: portfolio (supplier), symbol (part), ts, qty (signed), price, pnl, commission."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("portfolio"),
        F.col("l_partkey").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"),
        (F.col("l_extendedprice") * 0.0004).alias("commission"),
    )
