"""Self-join of texts on the Jaccard similarity of their word shingles, with adaptive prefixes.

Shingles are put in one global order, rare ones first. Two texts of at least the wanted similarity
share l shingles of their first n - ceil(t n) + l, for every l. Each text picks its own l: the one
with the least estimated cost, where reading a posting costs by the shingle's frequency and a candidate
costs its verification, and every candidate uses up l postings. A pair must then share as many prefix
shingles as the smaller of the two l. Frequencies come from a count sketch over all texts, whose size
follows the input's up to a bound; as an estimate it moves the cost and never the result.

Equal sets are one class, and a class is one node, named by the number of its first row. Candidates are verified
on whole shingle sets. Groups of near copies do not make all pairs: first every
text of a posting list is compared with one pivot of the list, then only lists that still hold more
than one component go on, and at last the smaller components of a list meet the rest of it. A pair in
one component needs no comparison, so components are exact. Before a pair is made, a sketch of parities of each
set gives a lower bound of their symmetric difference, which drops most pairs of a large group that can't link.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .skew import lookup
from .store import Kept, numbered, shuffled, sized, written
from .words import mix, shingle_sets

PARTS = 64
#: Bounds of the sketch, as bits of its number of 4-byte slots: a slot for so many bytes of input in between.
LEAST_BITS, MOST_BITS, SLOT_BYTES = 18, 23, 256
DEPTHS = (1, 2, 3, 4)
#: Lists with more texts than this are first compared with pivots.
LONG = 64
#: Postings, or bytes of shingle sets, that a task hands over at once.
SLICE = 1 << 17
SLICE_BYTES = 4 << 20
ODD = ["o0", "o1", "o2", "o3"]


def sketch_bits(docs: DataFrame) -> int:
    """Bits for the sketch by the size that Spark's statistics give for a table."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BITS, max(LEAST_BITS, (size // SLOT_BYTES).bit_length()))


def _print(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix(u).sum().view(np.int64)), int(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64))


def _parities(u: np.ndarray) -> np.ndarray:
    """256 bits as four int64: how many items fall on each, modulo 2. Sets that differ by d items differ in d bits at most."""
    return np.packbits(np.bincount((u & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).view(np.int64)


def _slots(u: np.ndarray, bits: int) -> np.ndarray:
    return (u >> np.uint64(64 - bits)).astype(np.int64)


def _scan(k: int, bits: int):
    """Of (row, text, other columns): row, the others, n, fa, fb, parities; at the end the task's sketch, in compressed parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, others = np.zeros(1 << bits, np.uint32), None
        for batch in batches:
            rows = []
            for _, u in shingle_sets(batch.column(1), k):
                rows.append((len(u), *(_print(u) if len(u) else (0, 0)), *_parities(u)))
                np.add.at(total, _slots(u, bits), np.uint32(1))
            n, others = len(rows), [batch.column(i) for i in range(2, batch.num_columns)]
            names = ["row", *(batch.schema.names[2:]), "n", "fa", "fb", *ODD, "part", "counts"]
            if n:
                x = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *others, *(pa.array(x[:, i]) for i in range(7)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if total.any():
            for part, x in enumerate(total.reshape(PARTS, -1)):
                one = [pa.nulls(1, pa.int64())] * 7
                yield pa.RecordBatch.from_arrays([one[0], *(pa.nulls(1, c.type) for c in others), *one, pa.array([part], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the pieces of each part of the sketch, one after the other."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(piece), np.uint32).astype(np.uint64)
            total[part] = total[part] + x if part in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def _sketch(pieces: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch: 2 ** bits numbers, whatever the input."""
    out = np.zeros((PARTS, (1 << bits) // PARTS), np.uint32)
    for part, counts in pieces.repartition(PARTS, "part").mapInArrow(_add, "part int, counts binary").collect():
        out[part] = np.frombuffer(counts, np.uint32)
    return out.reshape(-1)


def least(n: np.ndarray | int, num: int, den: int):
    """Shingles that a text of n shares with any partner, at least: ceil(num n / den)."""
    return -(-num * n // den)


def depth(frequency: np.ndarray, n: int, need: int) -> int:
    """The l of least estimated cost for a text of n shingles, whose rarest come first in frequency."""
    best, found = 0.0, 1
    for l in DEPTHS:
        if l > need:
            break
        postings = float(frequency[: n - need + l].sum())
        cost = postings + (postings / l) * (8 + n / 16)
        if l == 1 or cost < best:
            best, found = cost, l
    return found


def _postings(k: int, num: int, den: int, bits: int, sketch):
    """Of (row, text): token, row and l for each shingle of the text's prefix; a set that the task had just before gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = sketch.value
        seen: set[tuple[int, int]] = set()
        tokens, who, what, held = [], [], [], 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(who)), pa.array(np.concatenate(what))], ["token", "row", "l"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for r, u in shingle_sets(batch.column(1), k):
                if not len(u) or (p := _print(u)) in seen:
                    continue
                if len(seen) >= SLICE:
                    seen.clear()
                seen.add(p)
                f = np.maximum(frequency[_slots(u, bits)], 1)
                order = np.argsort(f, kind="stable")  # u is sorted, so ties go by hash
                need = int(least(len(u), num, den))
                l = depth(f[order[: len(u) - need + DEPTHS[-1]]].astype(np.float64), len(u), need)
                first = u[order[: len(u) - need + l]]
                tokens.append(first)
                who.append(np.full(len(first), ids[r], np.int64))
                what.append(np.full(len(first), l, np.int32))
                held += len(first)
                if held > SLICE:
                    yield give()
                    tokens, who, what, held = [], [], [], 0
        if held:
            yield give()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, held, got = batch.column(0), 0, 0, []
            for r, u in shingle_sets(batch.column(1), k):
                got.append(pa.array(u.view(np.int64)))
                held += u.nbytes
                if held > SLICE_BYTES or r + 1 == batch.num_rows:
                    off = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.slice(start, r + 1 - start), pa.ListArray.from_arrays(pa.array(off), pa.concat_arrays(got))], ["id", "items"])
                    start, held, got = r + 1, 0, []

    return run


class _Join:
    def __init__(self, rows: DataFrame, k: int, num: int, den: int, kept: Kept):
        self.rows, self.k, self.num, self.den, self.kept = rows, k, num, den, kept

    def verify(self, pairs: DataFrame, done: DataFrame | None) -> DataFrame:
        """(a, b, linked) for every pair (a, b) that isn't done, on whole shingle sets."""
        pairs = pairs.select("a", "b").distinct()
        if done is not None:
            pairs = pairs.join(shuffled(done.select("a", "b")), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        ids = written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "ids")
        sets = self.kept.add(self.rows.join(sized(ids), "row", "left_semi").select("row", "text").mapInArrow(_sets(self.k), "id long, items array<long>"))
        both = F.size(F.array_intersect("x", "y"))
        linked = (both > 0) & (both * self.den >= (F.size("x") + F.size("y") - both) * self.num)
        checked = pairs.join(shuffled(sets.select(F.col("id").alias("a"), F.col("items").alias("x"))), "a").join(shuffled(sets.select(F.col("id").alias("b"), F.col("items").alias("y"))), "b")
        return written(checked.select("a", "b", linked.alias("linked")), "checked")

    def fits(self):
        """Whether sizes and parities of a (na, a0..) and b (nb, b0..) allow a link: their symmetric difference is at most
        (1 - t) / (1 + t) of the sum of their sizes, and no less than the number of parities that differ."""
        lo, hi = F.least("na", "nb"), F.greatest("na", "nb")
        differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
        return (F.lit(self.den) * lo >= F.lit(self.num) * hi) & (differ * (self.den + self.num) <= (F.col("na") + F.col("nb")) * (self.den - self.num))


def _side(x: str) -> list:
    return [F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("l").alias(f"l{x}"), F.col("comp").alias(f"c{x}"), *(F.col(o).alias(f"{x}{i}") for i, o in enumerate(ODD))]


def _mixed(here: DataFrame) -> DataFrame:
    """token, c (members), top (of them in the largest component) and comp (that one) for lists of more than one component."""
    per = here.groupBy("token", "comp").agg(F.count("*").alias("c"))
    lists = per.groupBy("token").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.max(F.struct("c", F.negate("comp").alias("x"))).alias("most"))
    return lists.where("comps > 1").select("token", "c", F.col("most.c").alias("top"), F.negate("most.x").alias("comp"))


def row_components(rows: DataFrame, k: int, num: int, den: int, bits: int = MOST_BITS, rounds: int = 3) -> DataFrame:
    """Components of numbered rows: row, the other columns but text, n_shingles and component (the least row of it).

    rows: row (a long that no other row has, the same whenever it is read), text, and columns that go along. See
    ngram_components for what links; a row without shingles is a component of its own. bits: of the sketch.
    """
    spark, kept = rows.sparkSession, Kept()
    others = {f.name: f.dataType.simpleString() for f in rows.drop("row", "text").schema}
    names = {c: f"k{i}" for i, c in enumerate(others)}
    scan = rows.select("row", "text", *(F.col(c).alias(names[c]) for c in others))
    held = "".join(f", {names[c]} {t}" for c, t in others.items())
    scan = written(scan.mapInArrow(_scan(k, bits), f"row long{held}, n long, fa long, fb long, o0 long, o1 long, o2 long, o3 long, part int, counts binary"), "scan")
    sketch = spark.sparkContext.broadcast(_sketch(scan.where("part is not null").select("part", "counts"), bits))
    stat = scan.where("part is null").select("row", *names.values(), "n", *(F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("fa", "fb")))
    full = scan.where("part is null AND n > 0")
    classes = kept.add(full.groupBy("fa", "fb").agg(F.min("row").alias("rep"), F.count("*").alias("c"), F.min("n").alias("n"), *(F.min(o).alias(o) for o in ODD)))
    n_rows = stat.count()
    stat = written(lookup(stat, classes.select("fa", "fb", "c", "rep"), ["fa", "fb"], n_rows, F.col("row")).drop("fa", "fb"), "stat")

    job = _Join(rows, k, num, den, kept)
    nodes = kept.add(classes.select(F.col("rep").alias("id"), "n", *ODD))
    raw = written(rows.select("row", "text").mapInArrow(_postings(k, num, den, bits, sketch), "token long, row long, l int"), "postings")
    moved = kept.add(stat.where("rep <> row").select("row", "rep"))
    raw = raw.join(sized(moved), "row", "left").select("token", F.coalesce("rep", "row").alias("id"), "l")
    shared = raw.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("token", "df")
    post = written(raw.join(shuffled(shared), "token").groupBy("token", "id").agg(F.min("l").alias("l"), F.max("df").alias("df")), "shared")
    sketch.unpersist()

    # long lists first: their near copies are found by comparison with a pivot
    long = written(post.where(F.col("df") > LONG).drop("df").join(shuffled(nodes), "id"), "long")
    label = long.select("id").distinct().withColumn("comp", F.col("id"))
    done = None  # the pairs that were compared
    for step in range(rounds):
        here = written(long.join(shuffled(label), "id"), "lists")
        mixed = _mixed(here)
        size = mixed.agg(F.sum(F.col("c") - 1), F.sum((F.col("c") - F.col("top")) * F.col("c"))).first()
        if not size[0] or size[1] <= 4 * size[0]:
            break
        here = here.join(shuffled(mixed.select("token")), "token")
        pivot = here.groupBy("token").agg(F.min(F.struct((F.xxhash64("id", F.lit(step)) if step else F.col("id")).alias("h"), "id", "n", "l", "comp", *ODD)).alias("p"))
        pivot = pivot.select("token", "p.*").select("token", *_side("a"))
        pairs = here.select("token", *_side("b")).join(shuffled(pivot), "token").where((F.col("ca") != F.col("cb")) & job.fits())
        found = job.verify(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), done)
        label = components(label, found.where("linked"), rounds=1)  # stars need no more; what is left shows at the end
        done = found if done is None else done.unionByName(found)

    # then every pair that can still join two components, over all lists
    here = post.drop("df").join(shuffled(nodes), "id").join(shuffled(label), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    main = _mixed(here).select("token", F.col("comp").alias("main"))
    here = written(here.join(shuffled(main), "token"), "here")
    few = here.where("comp <> main").select("token", *_side("a"))
    all_ = here.select("token", "main", *_side("b"))
    pairs = few.join(shuffled(all_), "token").where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & job.fits())
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("la", "lb")).alias("l")).where("c >= l")
    found = job.verify(pairs, done)
    links = (found if done is None else found.unionByName(done)).where("linked")
    label = components(here.select("id", "comp").unionByName(label).distinct(), links)

    member = kept.add(classes.select("rep", "c")).join(shuffled(label.withColumnRenamed("id", "rep")), "rep", "left")
    member = written(member.select("rep", "c", F.coalesce("comp", "rep").alias("component")), "members")
    kept.release()
    out = lookup(stat, member, ["rep"], n_rows, F.col("row"))
    return out.select("row", *(F.col(names[c]).alias(c) for c in others), F.col("n").alias("n_shingles"), F.coalesce("component", "row").alias("component"))


def ngram_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rounds: int = 3) -> DataFrame:
    """Links texts whose shingle sets have den * intersection >= num * union and finds the components.

    docs: doc_id long, text string; other columns are ignored, whatever their names. Returns one row per
    row of docs: doc_id, n_shingles (distinct k-word shingles, A-Z lower-cased; a text of fewer words is
    one shingle) and component_id (the smallest doc_id that links reach, itself included).
    Links themselves are not listed: pairs inside a component are mostly never compared.
    Null, empty and blank texts have no shingles and no links. Every row is a text of its own: a row that repeats
    a doc_id links by its own text, one without a doc_id links as others do, and a component in which no row has a
    doc_id has no id. An empty table gives an empty result.
    """
    rows = numbered(docs, "row", ["doc_id", "text"])
    x = written(row_components(rows, k, num, den, sketch_bits(docs), rounds), "components")
    group = x.groupBy("component").agg(F.count("*").alias("c"), F.min("doc_id").alias("component_id"))
    return lookup(x, group, ["component"], x.count(), F.col("row")).select("doc_id", "n_shingles", "component_id")
