"""Joins to a table of one row per key where single keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import shuffled

#: A key is hot if it holds more than 1 / HOT of the rows, so there are fewer than HOT hot keys.
HOT = 1000


def lookup(big: DataFrame, small: DataFrame, keys: list[str], rows: int, spread: Column) -> DataFrame:
    """big left join small on keys, in which no task gets all rows of a hot key.

    small: keys, `c` (how many rows of big have the key) and values; one row per key, keys not null. rows: of big.
    The fewer than HOT keys with c * HOT > rows are broadcast, so big's rows of them stay where they are. `spread`, a
    long that differs between rows, deals these rows over the shuffle that the other keys need. Rows of big whose
    keys are null or not in small get null values.
    """
    values = [c for c in small.columns if c not in (*keys, "c")]
    hot = F.col("c") * HOT > F.lit(rows)
    few = small.where(hot).select(*keys, F.struct(*values).alias("_hot"))
    # 0 as a value that depends on the row: a constant would be taken out of the join's keys
    rest = small.where(~hot).select(*keys, F.least("c", F.lit(0)).cast("long").alias("_spread"), F.struct(*values).alias("_cold"))
    away = F.col("_hot").isNotNull()
    for k in keys:
        away = away | F.col(k).isNull()
    x = big.join(F.broadcast(few), keys, "left")  # fewer than HOT rows
    # rows that need no shuffled key get one of their own, 1 or more, which none of rest has
    x = x.withColumn("_spread", F.when(away, F.pmod(spread, F.lit(1 << 30)) + 1).otherwise(F.lit(0)).cast("long"))
    x = x.join(shuffled(rest), [*keys, "_spread"], "left")
    return x.select(*big.columns, *(F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values))
