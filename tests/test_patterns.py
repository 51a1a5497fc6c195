import datetime as dt

import numpy as np

from tickloom import schema
from tickloom.operators import patterns

T0 = dt.datetime(2024, 1, 1)


def frame(spark, prices):
    return spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), p, p, p, p, 1.0) for i, p in enumerate(prices)], schema.BARS)


def zigzag(points, step=4):
    out = []
    for a, b in zip(points, points[1:], strict=False):
        out += [float(v) for v in np.linspace(a, b, step, endpoint=False)]
    return [*out, float(points[-1])]


def test_gartley_by_hand(spark):
    # highs 200, 150 and lows 100; bearish points are L1 H2 L3 H4 of the last four swings each
    lows, highs = [100.0, 90.0, 138.2, 80.0], [170.0, 200.0, 150.0, 200.0]
    path = [150.0]
    for h, l in zip(highs, lows, strict=True):
        path += [h, l]
    path += [120.0]
    got = patterns.harmonics(frame(spark, zigzag(path)), w=2, tolerance=0.05).orderBy("ts").collect()
    x, a, b, d = lows[0], highs[1], lows[2], highs[3]
    want = [abs((b - a) / (a - x)), abs((d - b) / (b - a)), abs((d - a) / (a - x))]
    near = [1 - abs(r - t) / (0.05 * t) for r, t in zip(want, (0.618, 1.0, 0.786), strict=True)]
    expect = -sum(near) / 3 if min(near) >= 0 else 0.0
    assert abs(got[-1]["gartley"] - expect) < 1e-9
    assert all(-1 <= r["harmonic"] <= 1 for r in got)


def test_formations_find_a_double_top(spark):
    got = patterns.formations(frame(spark, zigzag([50, 100, 60, 120, 70, 120.5, 65, 90])), w=2).orderBy("ts").collect()
    assert got[-1]["double"] < 0
    assert all(-1 <= r[c] <= 1 for r in got for c in ("head_shoulders", "double", "triangle", "rectangle"))
