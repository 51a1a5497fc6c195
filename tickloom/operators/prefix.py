"""Places and running sums over all rows of a table in two passes, without a window over the whole of it.

Rows are dealt by ranges of an order and written once. A small table with a row for each range tells what lies before a range;
what is inside a range is a window over that range alone. So no task gets more than a range, however long the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder


def kept(x: DataFrame, name: str) -> DataFrame:
    """x, written to the shared folder and read again, so that it is made once and its lineage is cut."""
    path = new_folder(x.sparkSession, name)
    x.write.parquet(path)
    return x.sparkSession.read.schema(x.schema).parquet(path)


def dealt(x: DataFrame, order: list[str]) -> DataFrame:
    """x, sorted, with `_range` and `_at` (grows along the order; its low 33 bits are the place in the range). Nulls come first."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    x = x.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return kept(x, "ranges").withColumn("_range", F.shiftright("_at", 33))


def pieces(x: DataFrame, key: str) -> DataFrame:
    """(_range, key, first, n, before, piece): a row for each key in each range of a table dealt by (key, ...).

    first: the least _at; n: rows; before: rows of the key in earlier ranges; piece: its number from 0. One key has as many rows as
    it has ranges.
    """
    each = x.groupBy("_range", key).agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("_range")
    return each.select("_range", key, "first", "n", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), (F.row_number().over(w) - 1).alias("piece"))


def _ranges(x: DataFrame, **aggs) -> DataFrame:
    """A row for each range."""
    return x.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *(c.alias(n) for n, c in aggs.items()))


def numbered(x: DataFrame, order: list[str], name: str = "i", total: str | None = None) -> DataFrame:
    """x with its place from 0 in the order; total: also the number of rows."""
    x = dealt(x, order)
    r = _ranges(x)
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # a row for each range
    r = r.select("_range", "_first", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    x = x.join(F.broadcast(r), "_range").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
    if total:
        x = x.withColumn(total, F.col("_total"))
    return x.drop("_at", "_range", "_first", "_before", "_total")


def running(x: DataFrame, order: list[str], sums: dict[str, str], before: dict[str, str] | None = None) -> DataFrame:
    """x with running sums (name: column) and values of the row before (name: column) in the order; both cross ranges."""
    before = before or {}
    x = dealt(x, order)
    r = _ranges(x, **{f"_s_{n}": F.sum(c) for n, c in sums.items()}, **{f"_l_{n}": F.max_by(F.struct(c), "_at") for n, c in before.items()})
    w = Window.orderBy("_range")  # a row for each range
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    r = r.select("_range", *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums), *(F.lag(f"_l_{n}").over(w).alias(f"_l_{n}") for n in before))
    inside = Window.partitionBy("_range").orderBy("_at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(F.broadcast(r), "_range")
    x = x.withColumns(
        {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_s_{n}") for n, c in sums.items()}
        | {n: F.when(F.row_number().over(inside) == 1, F.col(f"_l_{n}")[c]).otherwise(F.lag(c).over(inside)) for n, c in before.items()}
    )
    return x.drop("_at", "_range", *(f"_s_{n}" for n in sums), *(f"_l_{n}" for n in before))
