"""Column builders over a symbol's ordered rows.

A window that isn't full gives null (`full`), counted on the non-null values of the column. Every builder takes the
key and order columns, so one partitioning and sort serves any number of columns in one select.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY, TIME = ("symbol",), ("ts",)


def ordered(key=KEY, time=TIME) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*time)


def frame(n: int, key=KEY, time=TIME, end: int = 0) -> WindowSpec:
    """The n rows that end `-end` rows before the current one."""
    return ordered(key, time).rowsBetween(end - n + 1, end)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full(agg: Column, c: Column, w: WindowSpec, n: int) -> Column:
    return F.when(F.count(c).over(w) == n, agg.over(w))


def roll(f, c: str | Column, n: int, key=KEY, time=TIME, end: int = 0) -> Column:
    """f over the last n values of c, null unless all n are there."""
    c, w = col(c), frame(n, key, time, end)
    return full(f(c), c, w, n)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def lag(c: str | Column, k: int = 1, key=KEY, time=TIME) -> Column:
    return F.lag(col(c), k).over(ordered(key, time))


def ret(c: str | Column = "close", n: int = 1, key=KEY, time=TIME) -> Column:
    """Simple return over n rows."""
    return ratio(col(c), lag(c, n, key, time)) - 1


def log_ret(c: str | Column = "close", key=KEY, time=TIME) -> Column:
    """Log return, null unless both prices are positive."""
    q = ratio(col(c), lag(c, 1, key, time))
    return F.when(q > 0, F.ln(q))


def sma(c: str | Column, n: int, **k) -> Column:
    """Simple moving average."""
    return roll(F.avg, c, n, **k)


def std(c: str | Column, n: int, population: bool = False, **k) -> Column:
    return roll(F.stddev_pop if population else F.stddev_samp, c, n, **k)


def highest(c: str | Column, n: int, **k) -> Column:
    return roll(F.max, c, n, **k)


def lowest(c: str | Column, n: int, **k) -> Column:
    return roll(F.min, c, n, **k)


def zscore(c: str | Column, n: int, population: bool = False, **k) -> Column:
    """Distance from the rolling mean in rolling deviations; null if they are 0."""
    return ratio(col(c) - sma(c, n, **k), std(c, n, population, **k))


def corr(x: str | Column, y: str | Column, w: WindowSpec) -> Column:
    """Correlation over the rows of w that have both; NaN where one of the two doesn't vary, for which F.corr raises an error."""
    a, b = col(x), col(y)
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(ratio(F.covar_pop(a, b).over(w), spread))


def running(f, c: str | Column, key=KEY, time=TIME, start: int | None = None, end: int = 0) -> Column:
    lo = Window.unboundedPreceding if start is None else start
    return f(col(c)).over(ordered(key, time).rowsBetween(lo, end))


def clamp(c: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """C limited to [lo, hi]."""
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def squash(c: Column, by: float) -> Column:
    """tanh(c / by)."""
    return F.tanh(c / by)


def skewness(c: str | Column, n: int, **k) -> Column:
    """Bias-corrected skewness of the last n values."""
    return roll(F.skewness, c, n, **k) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurtosis(c: str | Column, n: int, **k) -> Column:
    """Bias-corrected excess kurtosis of the last n values."""
    return ((n + 1) * roll(F.kurtosis, c, n, **k) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def last_known(c: str | Column, key=KEY, time=TIME) -> Column:
    """Forward fill."""
    return F.last(col(c), ignorenulls=True).over(ordered(key, time).rowsBetween(Window.unboundedPreceding, 0))


def next_known(c: str | Column, key=KEY, time=TIME) -> Column:
    return F.first(col(c), ignorenulls=True).over(ordered(key, time).rowsBetween(0, Window.unboundedFollowing))
