"""Count windows and pair decisions of streams in event time, with keyed state and timers.

Ticks of a key wait in buckets of time, as small binary parts of a map state; when the watermark has passed a bucket's end, its timer
sorts that bucket and nothing else, and goes through it in numpy slices. What is carried from bucket to bucket is the ring
of the last values and a position. So what is held at once is a bucket, whatever a micro-batch brings, and
ticks count in the order of their times also across micro-batches; ticks later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What keyed state with timers is kept in.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = np.dtype([("ts", "<i8"), ("leg", "<i4"), ("value", "<f8")])


def sliding_moments(held: np.ndarray, new: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the n values up to each new one; NaN until there are n. held: the values before, n - 1 at most.

    Sums run over values less their common mean and start anew with each call, so they stay small.
    """
    v = np.concatenate([held, new])
    center = v.mean() if len(v) else 0.0
    d = v - center
    s1, s2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    hi = np.arange(len(held) + 1, len(v) + 1)
    lo = np.maximum(hi - n, 0)
    mean = (s1[hi] - s1[lo]) / n
    var = (s2[hi] - s2[lo] - n * mean * mean) / max(n - 1, 1)
    full = hi >= n
    # where all n are the same, sums leave a rest of rounding
    same = np.maximum(var, 0) <= 1e-12 * np.maximum(1.0, (s2[hi] - s2[lo]) / n)
    return np.where(full, mean + center, np.nan), np.where(full & (n > 1), np.sqrt(np.where(same, 0.0, np.maximum(var, 0))), np.nan)


class _Buckets(StatefulProcessor):
    """Keeps ticks by bucket until the watermark has passed them and hands each bucket over, sorted by (ts, leg)."""

    every: int  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "bucket long, part int", "ticks binary")
        self.count = handle.getMapState("count", "bucket long", "n int")
        self.state = handle.getValueState("state", "a binary, b binary, position int")

    def rows(self, p: pd.DataFrame) -> np.ndarray:
        raise NotImplementedError

    def bucket(self, key: tuple, x: np.ndarray) -> pd.DataFrame | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for p in rows:
            x = self.rows(p)
            at = x["ts"] // (self.every * 1000)
            for b in map(int, np.unique(at)):
                n = self.count.getValue((b,))[0] if self.count.containsKey((b,)) else 0
                if not n:
                    self.handle.registerTimer((b + 1) * self.every)
                self.parts.updateValue((b, n), (x[at == b].tobytes(),))
                self.count.updateValue((b,), (n + 1,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = expiredTimerInfo.getExpiryTimeInMs() // self.every - 1
        got = []
        for i in range(self.count.getValue((b,))[0]):
            got.append(np.frombuffer(bytes(self.parts.getValue((b, i))[0]), ROW))
            self.parts.removeKey((b, i))
        self.count.removeKey((b,))
        x = np.concatenate(got)
        out = self.bucket(key, x[np.lexsort((x["leg"], x["ts"]))])
        if out is not None and len(out):
            yield out

    def held(self) -> tuple[np.ndarray, np.ndarray, int]:
        if not self.state.exists():
            return np.zeros(0), np.zeros(0), 0
        a, b, position = self.state.get()
        return np.frombuffer(bytes(a)), np.frombuffer(bytes(b)), position

    def close(self) -> None:
        pass


def _ticks(ts: pd.Series, leg: np.ndarray | int, value: pd.Series) -> np.ndarray:
    out = np.empty(len(ts), ROW)
    out["ts"], out["leg"], out["value"] = ts.to_numpy("datetime64[us]").astype(np.int64), leg, value.to_numpy(float)
    return out


def _time(us: np.ndarray) -> pd.Series:
    return pd.Series(us.astype("datetime64[us]"))


class ZScores(_Buckets):
    """Mean, deviation and z-score of a key's last n values, for every tick once there are n."""

    def __init__(self, key: str, value: str, n: int, every: int):
        self.key, self.value, self.n, self.every = key, value, n, every

    def rows(self, p: pd.DataFrame) -> np.ndarray:
        return _ticks(p["ts"], 0, p[self.value])

    def bucket(self, key: tuple, x: np.ndarray) -> pd.DataFrame:
        held, _, _ = self.held()
        mean, std = sliding_moments(held, x["value"], self.n)
        last = np.concatenate([held, x["value"]])[-(self.n - 1) :] if self.n > 1 else np.zeros(0)
        self.state.update((last.tobytes(), b"", 0))
        ok = ~np.isnan(mean)
        z = np.divide(x["value"] - mean, std, out=np.full(len(x), np.nan), where=std > 0)[ok]
        z = pd.Series(z).astype(object).where(~np.isnan(z), None)
        return pd.DataFrame({self.key: [key[0]] * int(ok.sum()), "ts": _time(x["ts"][ok]), self.value: x["value"][ok], "mean": mean[ok], "std": std[ok], "z": z})


def turns(z: np.ndarray, position: int, enter: float, leave: float) -> np.ndarray:
    """The position at each z: -1 from enter on, 1 from -enter on, 0 from inside leave on, else as before; NaN changes nothing."""
    out = np.empty(len(z), np.int32)
    for i, v in enumerate(z):
        if not np.isnan(v):
            position = (-1 if v >= enter else 1 if v <= -enter else 0) if position == 0 else 0 if abs(v) <= leave else position
        out[i] = position
    return out


class PairDecisions(_Buckets):
    """Z spread of the last n prices of two legs, their ratio of deviations and the position, for every tick of a pair with two full legs."""

    def __init__(self, n: int, enter: float, leave: float, every: int):
        self.n, self.enter, self.leave, self.every = n, enter, leave, every

    def rows(self, p: pd.DataFrame) -> np.ndarray:
        return _ticks(p["ts"], p["leg"].to_numpy(np.int32), p["price"])

    def bucket(self, key: tuple, x: np.ndarray) -> pd.DataFrame:
        *held, position = self.held()
        scores, stds, rest = [], [], []
        for leg, before in zip((1, 2), held, strict=True):
            own = x["value"][x["leg"] == leg]
            # the ring holds n values, so that the last tick of an earlier bucket still has its moments
            mean, std = sliding_moments(before[:-1], np.concatenate([before[-1:], own]), self.n)
            all_ = np.concatenate([before[-1:], own])
            at = np.cumsum(x["leg"] == leg) - (0 if len(before) else 1)  # the leg's last tick up to each row
            get = lambda v, at=at: np.where(at >= 0, v[np.maximum(at, 0)], np.nan) if len(v) else np.full(len(x), np.nan)
            scores.append(get(np.divide(all_ - mean, std, out=np.full(len(std), np.nan), where=std > 0)))
            stds.append(get(std))
            rest.append(np.concatenate([before, own])[-self.n :])
        with np.errstate(divide="ignore", invalid="ignore"):
            kappa = np.where(stds[1] > 0, stds[0] / stds[1], np.nan)
        z = scores[0] - kappa * scores[1]
        moves = turns(z, position, self.enter, self.leave)
        self.state.update((rest[0].tobytes(), rest[1].tobytes(), int(moves[-1])))
        ok = ~np.isnan(z)
        return pd.DataFrame({"pair": [key[0]] * int(ok.sum()), "ts": _time(x["ts"][ok]), "z": z[ok], "kappa": kappa[ok], "position": moves[ok]})


def _every(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def zscores(ticks: DataFrame, n: int = 60, key: str = "symbol", value: str = "price", late: str = "5 minutes", every: str = "1 minute") -> DataFrame:
    """Key, ts, value, mean, std, z for every tick of a stream (key, ts, value) once its key has n; z is null where they don't vary.

    A tick comes out when the watermark (late behind the newest) has passed its bucket of `every`. The session's state store must be PROVIDER.
    """
    kind = ticks.schema[key].dataType.simpleString()
    out = f"{key} {kind}, ts timestamp, {value} double, mean double, std double, z double"
    x = ticks.select(key, "ts", value).withWatermark("ts", late).groupBy(key)
    return x.transformWithStateInPandas(ZScores(key, value, n, _every(every)), out, "Append", "EventTime")


def pair_decisions(routed: DataFrame, n: int = 60, enter: float = 3.0, leave: float = 0.5, late: str = "5 minutes", every: str = "1 minute") -> DataFrame:
    """Pair, ts, z, kappa, position for every tick of a routed stream (pair, leg, ts, price) at which both legs have n prices that vary."""
    x = routed.select("pair", "leg", "ts", "price").withWatermark("ts", late).groupBy("pair")
    return x.transformWithStateInPandas(PairDecisions(n, enter, leave, _every(every)), "pair string, ts timestamp, z double, kappa double, position int", "Append", "EventTime")
