"""Shards by vector bin packing: bytes, tokens and rows balanced jointly.

Texts are grouped by equality. Most groups are small; they are dealt by hash into a fixed number of cells,
and each cell is packed as one group. Groups that hold more than a small share of all bytes, tokens or
rows are packed on their own; there can only be so many of them, whatever the input. A group above a
shard's fair share is split into pieces, since no packing can be even otherwise. Largest first, each
goes to the shard whose residual capacity has the highest dot product with its size vector among
those that still have room for it. The packing sees a bounded table; documents are only ever dealt by
cell, and places inside a shard come from running sums over small cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .store import numbered, written

#: Cells per shard for small groups; a group with more than 1 / (HEAVY * shards) of a dimension is packed on its own.
CELLS, HEAVY = 256, 32
#: Pieces for each shard's fair share that a larger group holds.
PIECES = 8
#: Rows in a slot range, about.
RANGE_ROWS = 1024


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of sizes (groups x dimensions), near equal in every dimension.

    Greedy, by falling largest normalized dimension; ties go to the earlier group and the lower shard. A group
    goes where the dot product with the residual capacity is highest. A shard has room while it
    stays below its fair share; if none has, the one with the least load after placing takes it.
    """
    total = sizes.sum(0).astype(float)
    share = sizes / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int64)
    for g in np.argsort(-share.max(1), kind="stable"):
        after = left - share[g]
        room = (after >= 0).all(1)
        score = np.where(room, left @ share[g], -np.inf) if room.any() else after.min(1)
        out[g] = int(score.argmax())
        left[out[g]] -= share[g]
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), tokens (words), text_crc32, shard and slot of each row of docs.

    docs: doc_id, text; other columns are ignored. Equal texts share a shard unless their group is larger than
    a shard's fair share; null counts as the empty text. Slots number a shard's rows from 0 without gaps, by
    cell and then doc_id (null first); rows that repeat a doc_id get slots of their own. An empty table gives an
    empty result.
    """
    t = F.coalesce("text", F.lit(""))
    x = numbered(docs, "row", ["doc_id", "text"]).select(
        "doc_id", "row",
        (F.octet_length(t) + 8).cast("long").alias("size"),
        word_count("text").alias("tokens"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("ga"),
        F.xxhash64(F.lit(7), F.reverse(F.md5(t.cast("binary")))).alias("gb"),
    )
    x = written(x, "sizes")
    groups = x.groupBy("ga", "gb").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = written(groups, "groups")
    dims = ["size", "tokens", "rows"]
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in dims)).first()
    cells = CELLS * shards
    big = F.lit(False)
    for c in dims:
        big = big | (F.col(c) * F.lit(HEAVY * shards) > F.lit(int(total[c])))
    # at most HEAVY * shards groups exceed the share of one dimension, so this list is bounded
    heavy = groups.where(big).orderBy("ga", "gb").collect()
    pieces = []
    for n, r in enumerate(heavy):
        parts = max(1, max(int(np.ceil(r[c] * shards / total[c])) if total[c] else 1 for c in dims))
        pieces.append((r["ga"], r["gb"], cells + n, parts if parts == 1 else PIECES * parts))
    spark = docs.sparkSession
    own = spark.createDataFrame(pieces, "ga long, gb long, own int, parts int")
    # rows are dealt by their number, since any share of them may have one doc_id or none
    key = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30))
    x = x.join(F.broadcast(own), ["ga", "gb"], "left").select(
        "doc_id", "row", "size", "tokens", "text_crc32",
        F.coalesce("own", F.pmod("ga", F.lit(cells)).cast("int")).alias("cell"),
        F.when(F.col("parts") > 1, F.pmod(key, F.col("parts"))).otherwise(F.lit(0)).cast("int").alias("piece"),
        key.alias("key"),
    )
    # what is packed, at most cells + PIECES * shards * (HEAVY + 3) rows, are the sums that the deal came to
    parts = x.groupBy("cell", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("cell", "piece").collect()
    home = pack(np.array([[float(r[c]) for c in dims] for r in parts]).reshape(-1, len(dims)), shards)
    home = spark.createDataFrame([(r["cell"], r["piece"], int(h)) for r, h in zip(parts, home, strict=True)], "cell int, piece int, shard int")
    x = x.join(F.broadcast(home), ["cell", "piece"])
    # a cell is cut into ranges in proportion to its rows, by the hash of their numbers
    per = x.groupBy("cell", "piece").agg(F.count("*").alias("n"))
    cuts = per.select("cell", "piece", F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS)).cast("int").alias("cuts")).where("cuts > 1")
    x = x.join(F.broadcast(cuts), ["cell", "piece"], "left").withColumn("range", F.pmod(F.shiftright("key", 8), F.coalesce("cuts", F.lit(1))).cast("int"))
    counts = x.groupBy("shard", "cell", "piece", "range").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("cell", "piece", "range").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select("shard", "cell", "piece", "range", (F.sum("n").over(order) - F.col("n")).alias("first"))
    inside = Window.partitionBy("cell", "piece", "range", "shard").orderBy("doc_id", "size", "text_crc32", "row")
    x = x.withColumn("slot", F.row_number().over(inside) - 1).join(starts, ["cell", "piece", "range", "shard"])
    return x.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("slot")).cast("long").alias("slot"))
