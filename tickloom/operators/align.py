"""Joins, calendars, pairs and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import last_known


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ts, close_a, close_b) on common times of two series (ts, close)."""
    return a.select("ts", F.col("close").alias("close_a")).join(b.select("ts", F.col("close").alias("close_b")), "ts")


def common_calendar(bars: DataFrame) -> DataFrame:
    """Bars at times that every symbol has. The calendar is a grouped count with partial sums."""
    n = bars.select("symbol").distinct().agg(F.count("*").alias("_n"))
    full = bars.groupBy("ts").agg(F.count_distinct("symbol").alias("k")).join(F.broadcast(n), F.col("k") == F.col("_n")).select("ts")
    return bars.join(full, "ts", "left_semi")


def union_calendar(bars: DataFrame) -> DataFrame:
    """Every symbol at every time that any symbol has; the close is filled forward and `filled` marks it.

    The calendar is small next to the bars (one row a time, not a tick), so it is spread over the symbols, a table of
    names, and never joined with bars themselves.
    """
    grid = bars.select("ts").distinct().join(bars.select("symbol").distinct(), how="cross")
    x = grid.join(bars, ["symbol", "ts"], "left")
    return x.select("symbol", "ts", last_known("close").alias("close"), F.col("close").isNull().alias("filled"))


def pairs(symbols: DataFrame) -> DataFrame:
    """Unordered pairs sym1 < sym2 of a table of symbols."""
    s = symbols.select("symbol").distinct()
    return s.select(F.col("symbol").alias("sym1")).join(s.select(F.col("symbol").alias("sym2")), F.col("sym1") < F.col("sym2"))


def pair_bars(bars: DataFrame, wanted: DataFrame | None = None, same: bool = False) -> DataFrame:
    """(sym1, sym2, ts, close1, close2) at common times. wanted: only these pairs (sym1, sym2), joined before the fan-out.

    An equi-join on ts, which Spark can split where a time has very many symbols; a screened list of pairs keeps the
    fan-out from growing with the square of the universe.
    """
    a = bars.select("ts", F.col("symbol").alias("sym1"), F.col("close").alias("close1"))
    b = bars.select("ts", F.col("symbol").alias("sym2"), F.col("close").alias("close2"))
    if wanted is not None:
        return a.join(wanted.select("sym1", "sym2"), "sym1").join(b, ["ts", "sym2"]).select("sym1", "sym2", "ts", "close1", "close2")
    on = F.col("sym1") <= F.col("sym2") if same else F.col("sym1") < F.col("sym2")
    return a.join(b, "ts").where(on).select("sym1", "sym2", "ts", "close1", "close2")


def attach_parameters(pair_table: DataFrame, params: DataFrame, key: str = "symbol") -> DataFrame:
    """A symbol's fitted parameters on both legs of each pair, as <name>1 and <name>2."""
    names = [c for c in params.columns if c != key]
    for leg in "12":
        pair_table = pair_table.join(params.select(F.col(key).alias(f"sym{leg}"), *(F.col(c).alias(f"{c}{leg}") for c in names)), f"sym{leg}")
    return pair_table


def widen(bars: DataFrame, symbols: list[str], fields: list[str] = ["close"]) -> DataFrame:  # noqa: B006
    """One row per ts with <field>_<symbol> columns; the symbols are stated, so no extra pass finds them."""
    x = bars.groupBy("ts").pivot("symbol", symbols).agg(*(F.first(f).alias(f) for f in fields))
    if len(fields) == 1:
        x = x.select("ts", *(F.col(f"`{s}`").alias(f"{fields[0]}_{s}") for s in symbols))
    else:
        x = x.select("ts", *(F.col(f"`{s}_{f}`").alias(f"{f}_{s}") for s in symbols for f in fields))
    return x


def lengthen(wide: DataFrame, columns: list[str], name: str = "symbol", value: str = "close") -> DataFrame:
    """Wide columns as rows."""
    return wide.unpivot(["ts"], columns, name, value)


def formation_windows(bars: DataFrame, days: int) -> DataFrame:
    """Each bar once per `days`-day window, sliding by a day, that lies wholly inside the data. Adds win_start.

    A bar belongs to `days` windows at most, so it is exploded to them rather than joined by range.
    """
    ends = bars.agg(F.to_date(F.min("ts")).alias("_a"), F.to_date(F.max("ts")).alias("_b"))
    x = bars.join(F.broadcast(ends), how="cross")  # one row
    d = F.to_date("ts")
    lo, hi = F.greatest(F.date_sub(d, days - 1), F.col("_a")), F.least(d, F.date_sub(F.col("_b"), days - 1))
    return x.withColumn("win_start", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<date>")))).drop("_a", "_b")


def walk_forward(bars: DataFrame, formation: int, test: int) -> DataFrame:
    """Bars by iteration: `formation` days and then `test` days, moved on by `test` days. Adds iter and phase.

    As in J9 a bar is exploded to the few iterations that hold it.
    """
    start = bars.agg(F.to_date(F.min("ts")).alias("_a"), F.to_date(F.max("ts")).alias("_b"))
    x = bars.join(F.broadcast(start), how="cross").withColumn("_d", F.datediff(F.to_date("ts"), "_a"))
    last = F.floor((F.datediff("_b", "_a") + 1 - formation) / test) - 1
    lo = F.greatest(F.lit(0), F.ceil((F.col("_d") - formation - test + 1) / test))
    hi = F.least(last, F.floor(F.col("_d") / test))
    x = x.withColumn("iter", F.explode(F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))))
    phase = F.when(F.col("_d") - F.col("iter") * test < formation, "formation").otherwise("test")
    return x.withColumn("phase", phase).drop("_a", "_b", "_d")


def last_in_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Symbol and the last close in [start, end)."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return bars.where((F.col("ts") >= lo) & (F.col("ts") < hi)).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.max("ts").alias("as_of"))


def as_of(left: DataFrame, right: DataFrame, values: list[str], key: str = "symbol") -> DataFrame:
    """For each left row (key, ts) the values of the latest right row at or before it.

    Union and forward fill by key and hour, without a range join; each hour starts with the last value before it, from a
    table of one row per key and hour, so a key with many rows is many groups.
    """
    rest = [c for c in left.columns if c not in (key, "ts")]
    a = left.select(key, "ts", F.lit(1).alias("_side"), *rest, F.lit(None).alias("_v"))
    b = right.select(key, "ts", F.lit(0).alias("_side"), *(F.lit(None).alias(c) for c in rest), F.struct(*values).alias("_v"))
    b = reduce(lambda d, c: d.withColumn(c, F.col(c).cast(left.schema[c].dataType)), rest, b)
    x = a.withColumn("_v", F.col("_v").cast(b.schema["_v"].dataType)).unionByName(b)
    x = x.withColumn("_hour", F.struct(F.to_date("ts"), F.hour("ts")))
    hours = x.groupBy(key, "_hour").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("ts"))).alias("_v"))
    before = Window.partitionBy(key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_v IS NOT NULL")
    x = x.unionByName(carried.withColumn("_side", F.lit(-1)), allowMissingColumns=True)  # without ts, so first of its hour
    w = Window.partitionBy(key, "_hour").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return x.select(key, "ts", *rest, *(F.col(f"_v.{v}").alias(v) for v in values))


def remaining(all_symbols: DataFrame, chosen: DataFrame) -> DataFrame:
    """Symbols that were not chosen."""
    return all_symbols.select("symbol").distinct().join(chosen.select("symbol"), "symbol", "left_anti")


def cointegrated_symbols(tests: DataFrame, corr: DataFrame, max_p: float = 0.05, min_corr: float = 0.7, k: int = 10) -> DataFrame:
    """At most k distinct symbols of the pairs that pass both screens, in order of p value. tests: sym1, sym2, p; corr: sym1, sym2, corr."""
    x = tests.where(F.col("p") < max_p).join(corr.where(F.col("corr") >= min_corr), ["sym1", "sym2"])
    x = x.select("p", F.posexplode(F.array("sym1", "sym2")).alias("leg", "symbol"), "sym1", "sym2")
    first = x.groupBy("symbol").agg(F.min(F.struct("p", "sym1", "sym2", "leg")).alias("at"))
    return first.orderBy("at").limit(k).select("symbol", F.col("at.p").alias("p"))


def hold_or_select(held: DataFrame, selected: DataFrame) -> DataFrame:
    """Pairs that are held or newly selected; flat pairs that are not selected go. held: sym1, sym2, position."""
    x = held.join(selected.select("sym1", "sym2", F.lit(True).alias("selected")), ["sym1", "sym2"], "full_outer")
    x = x.select("sym1", "sym2", F.coalesce("position", F.lit(0.0)).alias("position"), F.coalesce("selected", F.lit(False)).alias("selected"))
    return x.where((F.col("position") != 0) | F.col("selected"))


def check_submission(submission: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, keys only on either side, whether all is well and the first column is the key."""
    side = submission.groupBy(key).agg(F.count("*").alias("_a")).join(truth.groupBy(key).agg(F.count("*").alias("_b")), key, "full_outer")
    out = side.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("n_rows"),
        F.count("_a").alias("n_keys"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("unknown"),
    )
    return out.withColumn("ok", (F.col("n_rows") == F.col("n_keys")) & (F.col("missing") == 0) & (F.col("unknown") == 0) & F.lit(submission.columns[0] == key))


def complete_rows(x: DataFrame, features: list[str]) -> DataFrame:
    """Rows at times where every symbol is there with all features present."""
    ok: Column = reduce(lambda a, c: a & F.col(c).isNotNull(), features, F.lit(True))
    n = x.select("symbol").distinct().agg(F.count("*").alias("_n"))
    good = x.groupBy("ts").agg(F.count(F.when(ok, 1)).alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select("ts")
    return x.join(good, "ts", "left_semi")
