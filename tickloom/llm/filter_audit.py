"""How filters interact: what each order of five filters keeps and loses, from words of surviving subsets.

A document that fails the set f of filters survives a subset S of them if S and f have nothing in common. Over the 32 subsets
that is a truth table of 32 bits, the document's survival word. Words of a part are added by bit position with carry-save adders:
three words of one weight become a sum of that weight and a carry of the next, so that a few passes over an array count all 32
subsets at once. Everything else follows from the numbers of survivors N(S): what a step keeps is N of the filters so far, what it
removes is the difference, and so on for rows with a label.

Texts are read once. Only numbers are shuffled: by doc_id for the labels, by the text's print for equal texts; a task hands
over its counts for each part, so a part that holds a large share of the rows costs no more than others.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import WS
from .skew import lookup
from .store import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: The survival word of each set of failures: bit S is set if S and the set have nothing in common.
WORDS = [sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)]
#: Rows that a task counts at once; parts with fewer rows are counted by plain sums of bits.
ROWS, FEW = 1 << 18, 32


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (null: empty): under 50 words; distinct words under 65 %; over 5 % of A-Z; a character of #$%&*|."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, WS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    tests = [n < 50, 100 * distinct < 65 * n, F.lit(100) * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 5 * F.length(t), t.rlike(r"[#$%&*|]")]
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests[1:], 1)), F.when(tests[0], 1).otherwise(0))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the uint32 words have each of the 32 bits, by carry-save addition."""
    out, level, weight = np.zeros(32, np.int64), words, 1
    while len(level):
        carries = []
        while len(level) >= 3:
            m = len(level) // 3
            a, b, c = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * m :]])
        for x in level:  # two at most
            out += weight * ((int(x) >> np.arange(32)) & 1)
        level, weight = np.concatenate(carries) if carries else level[:0], weight * 2
    return out


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").astype(np.int64)


def part_counts(part: np.ndarray, words: np.ndarray, n_parts: int) -> np.ndarray:
    """The positional counts of each part's words, n_parts x 32. part: the number of each word's part."""
    order = np.argsort(part, kind="stable")
    words, size = words[order], np.bincount(part, minlength=n_parts)
    ends = np.cumsum(size)
    out = np.zeros((n_parts, 32), np.int64)
    for p in np.flatnonzero(size >= FEW):
        out[p] = positional_counts(words[ends[p] - size[p] : ends[p]])
    rest = np.repeat(size < FEW, size)
    if rest.any():
        np.add.at(out, np.sort(part)[rest], _bits(words[rest]))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (part, word, good, toxic): part and the counts of all, good and toxic words, 32 each."""
    held: list[pa.RecordBatch] = []

    def give() -> pa.RecordBatch:
        x = pa.Table.from_batches(held).combine_chunks()
        parts = x.column("part").chunk(0).dictionary_encode()
        part, names = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64), parts.dictionary
        words = x.column("word").to_numpy().astype(np.uint32)
        counts = [part_counts(part, words, len(names))]
        for label in ("good", "toxic"):
            has = x.column(label).to_numpy().astype(bool)
            counts.append(part_counts(part[has], words[has], len(names)))
        held.clear()
        flat = pa.array(np.concatenate(counts, 1).ravel())
        return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * 96), flat)], names=["part", "counts"])

    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= ROWS:
            yield give()
            n = 0
    if held:
        yield give()


def survival(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, word, good and toxic (0 or 1) of each row of docs.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are ignored. A null source is the part '', a null
    text is empty. E fails where a row with a smaller doc_id has the same text; rows without doc_id have no smaller one and are none, rows that share
    the smallest one all pass. A document has a label if any row of labels with its doc_id says so; without doc_id it has none.
    """
    t = F.coalesce("text", F.lit(""))
    x = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), failures(F.col("text")).alias("failed"),
        F.xxhash64(t).alias("ga"), F.xxhash64(F.lit(7), F.md5(t.cast("binary"))).alias("gb"), F.monotonically_increasing_id().alias("row"),
    )
    x = written(x, "failures")
    n = x.count()
    same = x.groupBy("ga", "gb").agg(F.count("*").alias("c"), F.min("doc_id").alias("first")).where("c > 1")
    x = lookup(x, written(same, "same"), ["ga", "gb"], n, F.col("row"))
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.select("doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic")).where("quality + toxic > 0")
    rows = x.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c"))
    marks = written(marks.join(rows, "doc_id"), "marks")
    x = lookup(x.select("doc_id", "part", "row", (F.col("failed") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("failed")), marks, ["doc_id"], n, F.col("row"))
    word = F.get(F.array(*map(F.lit, WORDS)).cast("array<long>"), F.col("failed").cast("int")).alias("word")
    return x.select("part", word, F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def survivors(words: DataFrame) -> DataFrame:
    """part and arrays of survivors by subset: n, good, toxic (bit i of a subset's number: filter i is in it)."""
    pieces = words.mapInArrow(_count, "part string, counts array<bigint>")
    total = pieces.groupBy("part").agg(*(F.sum(F.get("counts", F.lit(i))).alias(f"s{i}") for i in range(96)))
    return total.select("part", *(F.array(*(f"s{k * 32 + i}" for i in range(SUBSETS))).alias(name) for k, name in enumerate(("n", "good", "toxic"))))


def orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step keeps, removes and loses; see audit()."""
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, i in enumerate(order, 1):
            steps.append(("".join(FILTERS[j] for j in order), k, i, before, before | 1 << i))
            before |= 1 << i
    table = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(i).alias("f"), F.lit(a).alias("a"), F.lit(b).alias("b")) for o, k, i, a, b in steps))

    def shapley(i: int) -> Column:
        """Removed by filter i, over all orders: a subset comes before it in so many of them."""
        total = F.lit(0).cast("long")
        for s in (s for s in range(SUBSETS) if not s >> i & 1):
            k = s.bit_count()
            total = total + F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | 1 << i)))
        return total

    every, each = SUBSETS - 1, range(len(FILTERS))
    x = counts.select(
        "*", F.array(*map(shapley, each)).alias("value"),
        F.array(*(F.get("n", F.lit(every & ~(1 << i))) - F.get("n", F.lit(every)) for i in each)).alias("only"),
        F.array(*(F.get("n", F.lit(0)) - F.get("n", F.lit(1 << i)) for i in each)).alias("failing"),
    ).withColumn("x", F.explode(table)).select("*", "x.*")
    lost = lambda name: F.get(name, F.col("a")) - F.get(name, F.col("b"))
    return x.select(
        "part", "filter_order", "step", F.get("n", F.col("b")).alias("kept"), lost("n").alias("removed"), (F.get("failing", F.col("f")) - lost("n")).alias("redundant"),
        F.get("only", F.col("f")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("value", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, for all orders and steps.

    See survival() for nulls, ties and repeated rows. Extra columns are ignored. An empty table has no parts and gives no rows.
    """
    return orders(survivors(survival(docs, labels)))
