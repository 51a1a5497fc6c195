"""Event-time streams against a batch fold, and regimes and leverage against the rules followed bar by bar."""

import datetime as dt
import math

import numpy as np
import pytest

from tickloom.operators import regimes
from tickloom.streaming import stateful

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_sliding_moments_equal_loops():
    rng = np.random.default_rng(0)
    v = rng.normal(1e6, 1, 200)
    for cut in (0, 3, 50):
        held, new = v[max(0, cut - 9) : cut], v[cut:]
        mean, std = stateful.sliding_moments(held, new, 10)
        for i in range(len(new)):
            w = v[max(0, cut + i - 9) : cut + i + 1]
            if len(w) < 10:
                assert math.isnan(mean[i])
            else:
                assert mean[i] == pytest.approx(w.mean(), rel=1e-12) and std[i] == pytest.approx(w.std(ddof=1), rel=1e-6)
    assert stateful.sliding_moments(np.full(9, 5.0), np.full(3, 5.0), 10)[1].tolist() == [0.0] * 3


def drained(spark, stream, at):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(stream.schema).parquet(f"{at}/out").collect()


def test_pairs_follow_event_time_across_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    ticks = [("a|b", int(rng.integers(1, 3)), T0 + dt.timedelta(seconds=int(60 * i)), float(100 + rng.normal())) for i in range(160)]
    schema = "pair string, leg int, ts timestamp, price double"
    order = rng.permutation(150).tolist()  # both files hold all times, so the second brings ticks between those of the first
    for k, part in enumerate((order[:80], order[80:], range(150, 160))):
        spark.createDataFrame([ticks[i] for i in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {r["ts"]: r for r in drained(spark, stateful.pair_decisions(src, 8, 1.0, 0.3, "4 hours", "10 minutes"), tmp_path)}
    legs, position, want = {1: [], 2: []}, 0, {}
    for _, leg, ts, price in ticks:
        legs[leg] = [*legs[leg], price][-8:]
        if min(map(len, legs.values())) == 8:
            (m1, s1), (m2, s2) = ((np.mean(v), np.std(v, ddof=1)) for v in legs.values())
            z = (legs[1][-1] - m1) / s1 - s1 / s2 * (legs[2][-1] - m2) / s2
            position = (-1 if z >= 1 else 1 if z <= -1 else 0) if position == 0 else 0 if abs(z) <= 0.3 else position
            want[ts] = z, s1 / s2, position
    # the newest tick less four hours has passed nothing: all of it is in the state; with a short delay most comes out
    assert not got
    src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    got = {r["ts"].replace(tzinfo=dt.timezone.utc) if r["ts"].tzinfo is None else r["ts"]: r for r in drained(spark, stateful.pair_decisions(src, 8, 1.0, 0.3, "10 minutes", "10 minutes"), tmp_path / "b")}
    last = T0 + dt.timedelta(minutes=140)
    assert len(got) == len([t for t in want if t < last]) > 100
    for ts, r in got.items():
        z, kappa, position = want[ts]
        assert r["z"] == pytest.approx(z, abs=1e-9) and r["kappa"] == pytest.approx(kappa) and r["position"] == position


def test_turns_keep_a_position_until_it_is_left():
    z = np.array([0.0, 3.1, 2.0, np.nan, 0.4, -3.0, -0.6, 0.5])
    assert stateful.turns(z, 0, 3.0, 0.5).tolist() == [0, -1, -1, -1, 0, 1, 1, 0]


def rule(score, sure, was):
    if score is None or math.isnan(score):
        return was
    limit = {1: -0.25, -1: 0.25, 0: 0.2}[was]
    if sure <= (0.25 if abs(score) > 0.3 else 0.3):
        return 0
    return 1 if score > limit else -1 if score < -limit else 0


def test_regimes_equal_the_rule_followed_bar_by_bar(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", (T0 + dt.timedelta(hours=i)).replace(tzinfo=None), None if i < 5 else float(rng.normal(0, 0.3)), float(rng.choice([0.2, 0.28, 0.5]))) for k in range(3) for i in range(200)]
    x = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trend_score double, confidence double").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    got = {(r["symbol"], r["ts"]): r["regime"] for r in regimes.regimes(x).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    state = {}
    for s, ts, score, sure in rows:
        state[s] = rule(score, sure, state.get(s, 0))
        assert got[s, ts] == state[s]
    assert set(got.values()) == {-1, 0, 1}


def test_maps_of_regimes_compose():
    rng = np.random.default_rng(3)
    m = regimes.next_regimes(rng.normal(0, 0.4, 40), rng.uniform(0.2, 0.6, 40))
    for start in (-1, 0, 1):
        whole = regimes._follow(m, start)
        half = regimes._follow(m[:20], start)
        assert whole[-1] == regimes._follow(m[20:], int(half[-1]))[-1]


def test_leverage_of_a_bar_worked_out_by_hand(spark):
    """The last of 60 rising bars: regime 1, every momentum test true, calm."""
    n = 60
    close = [100 * 1.01**i for i in range(n)]
    rows = [("s", (T0 + dt.timedelta(hours=i)).replace(tzinfo=None), close[i], 0.2, 0.5, 0.4, 1) for i in range(n)]
    x = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volatility double, confidence double, trend_score double, regime int")
    got = [r["leverage"] for r in regimes.leverage(x).orderBy("ts").collect()]
    # base 8 * 2.68, volatility's place 1/3; the bound of a rising regime holds
    assert got[-1] == 5.0 and got[0] == 5.0
    down = x.withColumn("regime", x["regime"] * 0).withColumn("trend_score", x["trend_score"] * 0 - 0.9)
    got = [r["leverage"] for r in regimes.leverage(down).orderBy("ts").collect()]
    calm = 1 - (0.2 - 0.1) / 0.3 * 0.2 * 1.2
    assert got[5] == pytest.approx(max(1.0, 1.5 * 1.03 * calm))  # too few bars for returns and momentum
    d = 0.2 * 0.01 + 0.3 * (1.01**4 - 1) + 0.5 * (1.01**19 - 1)
    assert got[30] == pytest.approx(min(2.5, 1.5 * 1.03 * calm * (1 + d)))
    boost = min(4.0, 1 + 0.8 * 5 + (0.6 - 1 / 3) * 3 + 0.1 * 3)
    assert got[-1] == pytest.approx(min(2.5, 1.5 * 1.03 * calm * (1 + d) * boost))


def test_sink_covers_the_recent_hours_of_every_epoch(spark, tmp_path):
    from tickloom.streaming import jobs

    rng = np.random.default_rng(4)
    price = {s: 100 + rng.normal(0, 1, 60).cumsum() for s in "ab"}
    sink = jobs.covariance_sink(f"{tmp_path}/s", 6, {"a": 1.0, "b": 2.0})
    for epoch, hours in enumerate((range(0, 30), range(30, 31), range(31, 60), range(40, 42))):  # the last one brings nothing newer
        rows = [(s, T0 + dt.timedelta(hours=h), float(price[s][h])) for s in "ab" for h in hours]
        sink(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"), epoch)
        end = min(59, max(hours)) if epoch < 3 else 59
        recent = range(max(0, end - 5), end + 1)
        r = {s: np.diff(price[s][list(recent)]) / price[s][list(recent)[:-1]] for s in "ab"}
        got = {(x["sym1"], x["sym2"]): x["cov"] for x in spark.read.parquet(f"{tmp_path}/s/cov/epoch={epoch}").collect()}
        for s, t in (("a", "a"), ("a", "b"), ("b", "b")):
            assert got[s, t] == pytest.approx(float(np.cov(r[s], r[t])[0, 1]), rel=1e-9)
        value = sorted(x["value"] for x in spark.read.parquet(f"{tmp_path}/s/value/epoch={epoch}").collect())
        assert value == pytest.approx(sorted(price["a"][h] + 2 * price["b"][h] for h in recent))
    sink(spark.createDataFrame([], "symbol string, ts timestamp, close double"), 4)
