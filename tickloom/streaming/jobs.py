"""Streams of ticks: bars, count windows and pair decisions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stateful import turns


def stream_bars(ticks: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Bars by tumbling window; ticks later than the watermark are dropped. ticks: symbol, ts (timestamp), price, volume."""
    w = ticks.withWatermark("ts", late).groupBy(F.window("ts", every), "symbol")
    x = w.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"))
    return x.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "n")


def window_moments(held: np.ndarray, new: np.ndarray, n: int, skip: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the n values up to each new one; NaN until there are n. held: the values before, n - 1 at most.

    skip: missing values (NaN) don't count among the n; else they make the window's moments NaN. Each window is summed anew, some windows at once;
    where all its values are the same, the mean is that value and the deviation 0, without a rest of rounding.
    """
    v, mean, std = np.concatenate([held, new]), np.full(len(new), np.nan), np.full(len(new), np.nan)
    if len(v) < n:
        return mean, std
    w, at, most = np.lib.stride_tricks.sliding_window_view(v, n), len(new) - (len(v) - n + 1), max(1, (1 << 18) // n)
    with np.errstate(divide="ignore", invalid="ignore"):
        for lo in range(0, len(w), most):
            x = w[lo : lo + most]
            there = ~np.isnan(x) if skip else np.ones(x.shape, bool)
            k = there.sum(1)
            m = np.where(there, x, 0.0).sum(1) / k
            low, high = np.where(there, x, np.inf).min(1), np.where(there, x, -np.inf).max(1)
            m = np.where(low == high, low, m)
            d = np.where(there, x - m[:, None], 0.0)
            mean[at + lo : at + lo + len(x)] = m
            std[at + lo : at + lo + len(x)] = np.where(k > 1, np.sqrt((d * d).sum(1) / np.maximum(k - 1, 1)), np.nan)
    return mean, std


class _ZScores:
    """Moments and z-scores of one key's values, in slices; state is the last n - 1 values."""

    def __init__(self, n: int, value: str):
        self.n, self.value, self.state = n, value, (b"", b"", 0)

    def take(self, p: pd.DataFrame) -> pd.DataFrame:
        held, v = np.frombuffer(self.state[0]), p[self.value].to_numpy(float, na_value=np.nan)
        mean, std = window_moments(held, v, self.n)
        all_ = np.concatenate([held, v])
        self.state = all_[max(0, len(all_) - self.n + 1) :].tobytes(), b"", 0
        full = np.arange(len(held) + 1, len(all_) + 1) >= self.n
        z = np.divide(v - mean, std, out=np.full(len(v), np.nan), where=std > 0)
        return p.assign(mean=mean, std=std, z=z)[full]


class _PairDecisions:
    """Spread scores and positions of one pair, in slices; state is the last n prices of each leg and the position."""

    def __init__(self, n: int, enter: float, leave: float):
        self.n, self.enter, self.leave, self.state = n, enter, leave, (b"", b"", 0)

    def take(self, p: pd.DataFrame) -> pd.DataFrame:
        leg, price, position = p["leg"].to_numpy(), p["price"].to_numpy(float, na_value=np.nan), self.state[2]
        scores, stds, rest = [], [], []
        for side in (1, 2):
            before = np.frombuffer(self.state[side - 1])
            own = np.concatenate([before[-1:], price[leg == side]])  # the last price of before has its moments still
            mean, std = window_moments(before[:-1], own, self.n, skip=False)
            at = np.cumsum(leg == side) - (0 if len(before) else 1)  # the leg's last price up to each row
            get = lambda v, at=at: np.where(at >= 0, v[np.maximum(at, 0)], np.nan) if len(v) else np.full(len(at), np.nan)
            scores.append(get(np.divide(own - mean, std, out=np.full(len(std), np.nan), where=std > 0)))
            stds.append(get(std))
            rest.append(np.concatenate([before[:-1], own])[-self.n :])
        with np.errstate(divide="ignore", invalid="ignore"):
            kappa = np.where((stds[0] > 0) & (stds[1] > 0), stds[0] / stds[1], np.nan)
        z = scores[0] - kappa * scores[1]
        moves = turns(z, position, self.enter, self.leave)
        self.state = rest[0].tobytes(), rest[1].tobytes(), int(moves[-1]) if len(moves) else position
        return p.assign(z=z, kappa=kappa, position=moves)[~np.isnan(z)]


def _in_slices(make: Callable[[], _ZScores | _PairDecisions], key: str, columns: list[str], now: int):
    """A mapInPandas function over rows in order of key, state row before ticks and time: results (tick true), and a state row for each key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fold, seen = None, None, None

        def filled(p: pd.DataFrame) -> pd.DataFrame:
            return p.assign(**{c: None for c in columns if c not in p})[columns]

        def kept() -> pd.DataFrame:
            a, b, position = fold.state
            return filled(pd.DataFrame({key: [at], "tick": [False], "a": [a], "b": [b], "position": [position], "seen": [seen]}))

        for p in frames:
            k = p[key].astype(object).where(p[key].notna(), None).to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if fold is None or k[lo] != at:
                    if fold is not None:
                        yield kept()
                    at, fold = k[lo], make()
                q = p.iloc[lo:hi]
                if not q["tick"].iloc[0]:
                    fold.state, seen = (bytes(q["a"].iloc[0]), bytes(q["b"].iloc[0]), int(q["position"].iloc[0])), int(q["seen"].iloc[0])
                    q = q.iloc[1:]
                if len(q):
                    seen = now
                    yield filled(fold.take(q.drop(columns=["a", "b", "position", "seen"])))
        if fold is not None:
            yield kept()

    return run


def _sink(path: str, make: Callable[[], _ZScores | _PairDecisions], key: str, order: list[str], out: str, idle: str | None):
    """A foreachBatch function that takes each key's ticks in order behind its state of the epoch before, and writes results and states by epoch.

    Spark sorts the ticks of a micro-batch and hands them over some thousands at a time, so that no key's ticks are one frame, whatever a
    micro-batch brings. A repeated epoch replaces itself.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark, now = batch.sparkSession, int(time.time() * 1000)
        columns = f"{key} {batch.schema[key].dataType.simpleString()}, {out}, tick boolean, a binary, b binary, seen long" + ("" if "position" in out else ", position int")
        x = batch.select(key, *order).withColumn("tick", F.lit(True))
        if epoch:
            s = spark.read.schema(columns).parquet(f"{path}/epoch={epoch - 1}").where("not tick").select(key, "tick", "a", "b", "position", "seen")
            x = x.unionByName(s.where(F.col("seen") >= now - _ms(idle)) if idle else s, allowMissingColumns=True)
        else:
            x = x.selectExpr("*", "CAST(NULL AS binary) AS a", "CAST(NULL AS binary) AS b", "CAST(NULL AS int) AS position", "CAST(NULL AS long) AS seen")
        x = x.repartition(key).sortWithinPartitions(key, "tick", *(F.col(c).asc_nulls_last() for c in order))
        names = [c.split()[0] for c in columns.split(", ")]
        x.mapInPandas(_in_slices(make, key, names, now), columns).write.mode("overwrite").partitionBy("tick").parquet(f"{path}/epoch={epoch}")

    return run


def sink_results(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What a sink below has written so far, by the columns that it names."""
    return spark.read.schema(f"{columns}, tick boolean, epoch int").parquet(path).where("tick").drop("tick", "epoch")


def zscore_sink(path: str, n: int = 60, key: str = "symbol", value: str = "price", idle: str | None = None):
    """A foreachBatch function over ticks (key, ts, value): mean, sample deviation and z-score of the last n values of each key, for every tick once there are n.

    State is the last n - 1 values of a key (and goes after an idle time, if one is given); ticks of one micro-batch are taken in time order.
    Results (key, ts, value, mean, std, z) are read by sink_results.
    """
    return _sink(path, lambda: _ZScores(n, value), key, ["ts", value], f"ts timestamp, {value} double, mean double, std double, z double", idle)


def _ms(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def route_to_pairs(ticks: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Each tick once for every pair that it is a leg of: pair, leg, ts, price. The pairs are a short stated list."""
    at: dict[str, list[tuple[str, int]]] = {}
    for a, b in pairs:
        at.setdefault(a, []).append((f"{a}|{b}", 1))
        at.setdefault(b, []).append((f"{a}|{b}", 2))
    out = F.array().cast("array<struct<pair:string,leg:int>>")
    for s, ps in sorted(at.items()):
        out = F.when(F.col("symbol") == s, F.array(*(F.struct(F.lit(p).alias("pair"), F.lit(g).alias("leg")) for p, g in ps))).otherwise(out)
    return ticks.select("ts", "price", F.inline(out))


def pair_sink(path: str, n: int = 60, enter: float = 3.0, leave: float = 0.5, idle: str | None = None):
    """A foreachBatch function over a routed stream (pair, leg, ts, price): for each tick at which both legs have n prices that vary the z spread z1 - kappa z2, kappa = std1 / std2, and the position.

    State per pair: the last n prices of each leg and the position. Results (pair, ts, z, kappa, position) are read by sink_results.
    """
    return _sink(path, lambda: _PairDecisions(n, enter, leave), "pair", ["ts", "leg", "price"], "ts timestamp, z double, kappa double, position int", idle)


def covariance_sink(path: str, keep_hours: int = 24, weights: dict[str, float] | None = None):
    """A foreachBatch function: appends the batch's bars and writes return covariances over the recent hours below `path`.

    Bars are kept by day and only the days of the recent hours are read, so an epoch's work doesn't grow with the history; the newest
    time is remembered between epochs and looked up once after a start. With weights (holdings by symbol, a stated list) it also writes the
    portfolio's value at each of these hours, of the symbols that have a bar then.
    """
    from ..functions.rolling import ret
    from ..operators.gram import covariances

    newest: dict[str, object] = {}

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = batch.select("symbol", "ts", "close").withColumn("day", F.to_date("ts"))
        held.write.mode("overwrite").partitionBy("day").parquet(f"{path}/bars/epoch={epoch}")  # a repeated epoch replaces itself
        bars = spark.read.schema(T.StructType([*held.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(f"{path}/bars")
        mine = bars.where(F.col("epoch") == epoch) if "end" in newest else bars
        end = max((t for t in (newest.get("end"), mine.agg(F.max("ts")).first()[0]) if t is not None), default=None)
        if end is None:
            return
        newest["end"] = end
        since = F.lit(end) - F.expr(f"INTERVAL {keep_hours} HOURS")
        bars = bars.where((F.col("day") >= F.to_date(since)) & (F.col("ts") > since)).select("symbol", "ts", "close").distinct()
        covariances(bars.withColumn("ret", ret()), per_year=1.0).write.mode("overwrite").parquet(f"{path}/cov/epoch={epoch}")
        if weights:
            share = F.element_at(F.create_map(*(F.lit(v) for kv in sorted(weights.items()) for v in kv)), F.col("symbol"))
            bars.groupBy("ts").agg(F.sum(share * F.col("close")).alias("value")).write.mode("overwrite").parquet(f"{path}/value/epoch={epoch}")

    return run


def formation_stream(ticks: DataFrame, length: str = "3 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, deviation and count of prices over sliding windows of several days."""
    x = ticks.withWatermark("ts", late).groupBy(F.window("ts", length, step), "symbol").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"), F.count("*").alias("n"))
    return x.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "std", "n")
