"""Which rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; a row without id is not held out, and is not learnt from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def some(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` rows with a doc_id that isn't held out, chosen by a hash of it."""
    return rows.where(F.col("doc_id").isNotNull() & ~held_out()).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
