import datetime as dt
import importlib.util

import pytest
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import rolling as R
from tickloom.operators import align, clean

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, 1.0) for i in range(4)]
    rows.append(("b", T0, 0.0, 0.0, 0.0, 0.0, 0.0))
    return spark.createDataFrame(rows, schema.BARS)


def test_full_windows_and_zero_prices(bars):
    rows = {(r[0], r[1]): r for r in bars.select("symbol", "ts", R.sma("close", 3), R.ret(), R.zscore("close", 2)).collect()}
    assert rows["a", T0][2] is None and rows["a", T0 + dt.timedelta(hours=2)][2] == 11.0
    assert rows["b", T0][2:] == (None, None, None)


def test_pairs_count(bars):
    assert align.pairs(bars).count() == 1


def test_calendars(bars):
    assert align.common_calendar(bars).count() == 2
    assert align.union_calendar(bars).count() == 8


def test_split_covers_all(bars):
    assert {r["part"] for r in clean.split_by_time(bars, 0.5, 0.25).collect()} == {"train", "validation", "test"}


def test_empty(spark):
    e = spark.createDataFrame([], schema.BARS)
    assert clean.validate(e).count() == 0 and align.common_calendar(e).count() == 0 and schema.resample(e).count() == 0


def test_entry_registers_queries():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    if importlib.util.find_spec("tickloom.llm") is None:
        assert not any(k.startswith("op") for k in q)


def test_as_of_splits_a_symbol_by_hour(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    left = [("a", at(7 * i), i) for i in range(300)] + [("b", at(5), 1000)]
    right = [("a", at(m), float(m)) for m in (30, 60, 61, 500, 1400, 1401)]
    x = align.as_of(spark.createDataFrame(left, "symbol string, ts timestamp_ntz, n long"), spark.createDataFrame(right, "symbol string, ts timestamp_ntz, close double"), ["close"])
    got = x.withColumn("part", F.spark_partition_id()).collect()
    want = {n: max((c for k, u, c in right if k == s and u <= t), default=None) for s, t, n in left}
    assert {r["n"]: r["close"] for r in got} == want and len(got) == len(left)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert all("_hour" in line for line in plan.splitlines() if "Window [last(_v" in line)
