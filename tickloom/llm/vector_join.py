"""Near-duplicate vectors by a subspace pigeonhole join on rotated unit vectors.

Unit vectors of cosine c or more are at a squared distance of 2 - 2 c at most. All are turned by one rotation, which spreads
what they have in common over all coordinates, and cut into blocks of BLOCK coordinates. The squared distance is the sum of
the blocks' squared distances, so a pair that links is within a block's share of the budget in one block at least. Each block is
joined on that range, and a pair that some block lets through is verified by its cosine in double precision.

The range join works on tiles. A vector belongs to the nearest of a bounded number of landmarks, and a landmark's vectors
are dealt by hash into tiles of about TILE. In each block a tile is a ball; it enters the cells of a grid over the block's first
coordinates that its ball, widened by half the range, touches, and tiles that meet in a cell and whose balls come near enough are a pair
of tiles. Pairs of tiles are what is joined and spread over tasks, so a large group of near copies is many pairs and
no task holds more than two tiles. Within a pair the blocks are compared by matrix products. A task hands over a number of links and
one edge for each vector that has links there, never the pairs themselves. Where vectors have no structure at all, nearly
all pairs of tiles are compared: the range of one block then says little, and the cost grows with the square of the table.

Equal vectors are one class with a count; only one of them is compared.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .skew import lookup
from .store import numbered, sized, written

BLOCK, TILE = 16, 2048
#: Landmarks, at most; a bounded sample of the vectors that decides only which ones share a tile.
LANDMARKS = 256
#: What single precision may add to a squared distance of unit vectors.
SLACK = 1e-4


@functools.lru_cache(8)
def rotation(size: int) -> np.ndarray:
    """An orthogonal matrix, the same for every call."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(size)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def blocks(size: int) -> list[tuple[int, int]]:
    """Blocks of about BLOCK coordinates each, all within one of another; 62 at most, larger ones where there are many coordinates."""
    n = max(1, min(62, round(size / BLOCK)))
    cut = [size * i // n for i in range(n + 1)]
    return list(zip(cut, cut[1:], strict=False))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (row, embedding): row, size and the values as bytes, in single precision if that loses nothing; null for a vector that links with nothing."""
    for batch in batches:
        column = batch.column(1)
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)  # without the values of null lists
        ends = np.cumsum(size)
        raw = []
        for n, end in zip(size, ends, strict=True):
            v = values[end - n : end]
            if not n or not np.isfinite(v).all() or not v.any():
                raw.append(None)
                continue
            with np.errstate(over="ignore"):
                short = v.astype(np.float32)
            raw.append((short if (short == v).all() else v).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], names=["row", "size", "raw"])


def turned(raw: pa.Array, size: int) -> np.ndarray:
    """The unit vectors of values as _parse gives them, turned."""
    parts = [x.as_buffer() for x in raw]
    x = np.stack([np.frombuffer(p, np.float32 if p.size == 4 * size else np.float64).astype(np.float64) for p in parts])
    x /= np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
    x /= np.sqrt((x * x).sum(1))[:, None]
    return x @ rotation(size)


def _assign(marks):
    """Of (row, c, size, raw): the same and cell, the number of the nearest landmark of that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            cell = np.zeros(len(sizes), np.int32)
            for size in map(int, np.unique(sizes)):
                if size not in known:
                    known[size] = turned(pa.array(marks.value[size], pa.binary()), size) if size in marks.value else np.zeros((1, size))
                at = np.flatnonzero(sizes == size)
                for part in np.array_split(at, -(-len(at) // TILE)):
                    cell[part] = (turned(batch.column(3).take(pa.array(part)), size) @ known[size].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["row", "c", "size", "raw", "cell"])

    return run


def _grid(reach: float):
    """Of tiles (tile, size, raw): tile, size, block, gx, gy (a cell that the tile's ball enters), center and radius in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tile, size = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                x, rows = turned(batch.column(2)[k].values, size), []
                for b, (lo, hi) in enumerate(blocks(size)):
                    part = x[:, lo:hi]
                    center = part.mean(0)
                    radius = float(np.sqrt(((part - center) ** 2).sum(1).max())) + 1e-9
                    wide = np.sqrt(reach * (hi - lo) / size)  # the range of the block, and the cells' width
                    span = [range(int(np.floor((c - radius) / wide - 0.5)), int(np.floor((c + radius) / wide + 0.5)) + 1) for c in center[:2]]
                    rows += [(b, gx, gy, center.tobytes(), radius) for gx in span[0] for gy in (span[1] if len(span) > 1 else [0])]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tile] * len(rows), pa.int64()), pa.array([size] * len(rows), pa.int32()), *(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.float64())],
                    names=["tile", "size", "block", "gx", "gy", "center", "radius"],
                )

    return run


def _near(reach: float):
    @F.arrow_udf("boolean")
    def near(size: pa.Array, block: pa.Array, a: pa.Array, ra: pa.Array, b: pa.Array, rb: pa.Array) -> pa.Array:
        out = []
        for n, k, x, rx, y, ry in zip(*(c.to_pylist() for c in (size, block, a, ra, b, rb)), strict=True):
            lo, hi = blocks(n)[k]
            apart = np.frombuffer(x) - np.frombuffer(y)
            out.append(bool(np.sqrt((apart * apart).sum()) <= rx + ry + np.sqrt(reach * (hi - lo) / n)))
        return pa.array(out, pa.bool_())

    return near


def compare(x: np.ndarray, y: np.ndarray, mask: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the linked pairs of turned unit vectors x and y; i < j if they are the same tile. mask: blocks to join on."""
    reach, size = 2 - 2 * cosine, x.shape[1]
    found = [np.zeros(0, np.int64)]
    for b, (lo, hi) in enumerate(blocks(size)):
        if mask >> b & 1:
            u, v = x[:, lo:hi].astype(np.float32), y[:, lo:hi].astype(np.float32)
            # x.y - (|x|^2 + |y|^2) / 2 is minus half the squared distance
            u = np.concatenate([u, np.ones((len(u), 1), np.float32), -(u * u).sum(1, keepdims=True) / 2], 1)
            v = np.concatenate([v, -(v * v).sum(1, keepdims=True) / 2, np.ones((len(v), 1), np.float32)], 1)
            found.append(np.flatnonzero(u @ v.T >= np.float32(-(reach * (hi - lo) / size + SLACK) / 2)))
    at = np.unique(np.concatenate(found))
    i, j = at // len(y), at % len(y)
    if same:
        i, j = i[i < j], j[i < j]
    good = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        s = slice(k, k + (1 << 16))
        good[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= cosine
    return i[good], j[good]


def groups(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least place of each one's component among n, by passing labels along the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(cosine: float):
    """Of pairs of tiles (size, mask, same, rows, counts and values of both): row, links (vectors linked with), root (one of its component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size, mask, same = (batch.column(i)[k].as_py() for i in range(3))
                ra, ca, rb, cb = (batch.column(i)[k].values.to_numpy() for i in range(3, 7))
                x, y = turned(batch.column(7)[k].values, size), turned(batch.column(8)[k].values, size)
                i, j = compare(x, y, mask, cosine, same)
                if not len(i):
                    continue
                n = len(ra)
                rows = ra if same else np.concatenate([ra, rb])
                at = j if same else j + n
                links = np.bincount(i, cb[j], len(rows)) + np.bincount(at, ca[i], len(rows))
                own = np.flatnonzero(links)
                root = groups(i, at, len(rows))[own]
                yield pa.RecordBatch.from_arrays([pa.array(rows[own]), pa.array(np.rint(links[own]).astype(np.int64)), pa.array(rows[root])], names=["row", "links", "root"])

    return run


def vector_components(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links (other rows of that cosine or more), component_id (the smallest vec_id that links reach), kept (vec_id is that one).

    vectors: vec_id, embedding (a list of numbers); other columns are ignored. A vector that is null, empty or zero or holds a null
    or non-finite component links with nothing; vectors of different lengths don't link. Equal vectors link with each other. Every
    row counts for itself: rows that share a vec_id each have a row in the result, rows without one link as others do; a
    component in which no row has a vec_id has no id, and its rows are kept. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = numbered(vectors, "row", ["vec_id", "embedding"])
    parsed = written(rows.select("row", F.col("embedding").cast("array<double>")).mapInArrow(_parse, "row long, size int, raw binary"), "values")
    prints = parsed.select("row", "size", "raw", F.xxhash64("raw").alias("fa"), F.xxhash64(F.lit(7), F.md5("raw")).alias("fb")).where("raw IS NOT NULL")
    n = prints.count()
    classes = written(prints.groupBy("fa", "fb", "size").agg(F.min("row").alias("rep"), F.count("*").alias("c")), "classes")
    member = written(lookup(prints.drop("raw"), classes, ["fa", "fb", "size"], n, F.col("row")).select("row", "rep"), "members")
    reps = prints.select(F.col("row").alias("rep"), "raw").join(classes, "rep").select(F.col("rep").alias("row"), "c", "size", "raw")
    reps = written(reps, "reps")

    # a few vectors of the commonest lengths, at most LANDMARKS in all; other lengths have one cell each
    sizes = [r[0] for r in reps.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(8).collect()]
    most = max(1, min(LANDMARKS // max(1, len(sizes)), -(-n // TILE)))
    marks = {size: [bytes(r[0]) for r in reps.where(F.col("size") == size).orderBy(F.xxhash64("row", F.lit(5)), "row").limit(most).select("raw").collect()] for size in sizes}
    placed = written(reps.mapInArrow(_assign(spark.sparkContext.broadcast(marks)), "row long, c long, size int, raw binary, cell int"), "placed")
    per = placed.groupBy("size", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("row", F.lit(9)), F.col("chunks")).cast("int").alias("chunk")
    dealt = placed.join(sized(written(per, "cells")), ["size", "cell"]).select("size", "cell", chunk, F.struct("row", "c", "raw").alias("x"))
    tiles = dealt.groupBy("size", "cell", "chunk").agg(F.collect_list("x").alias("x"))
    tiles = tiles.select(F.xxhash64("size", "cell", "chunk").alias("tile"), "size", F.col("x.row").alias("rows"), F.col("x.c").alias("counts"), F.col("x.raw").alias("raw"))
    tiles = written(tiles, "tiles")

    reach = 2 - 2 * cosine
    balls = written(tiles.select("tile", "size", "raw").mapInArrow(_grid(reach), "tile long, size int, block int, gx int, gy int, center binary, radius double"), "balls")
    a, b = (balls.select("size", "block", "gx", "gy", *(F.col(c).alias(f"{x}_{c}") for c in ("tile", "center", "radius"))) for x in "ab")
    met = a.join(b, ["size", "block", "gx", "gy"]).where("a_tile <= b_tile").drop("gx", "gy").dropDuplicates(["block", "a_tile", "b_tile"])
    met = met.where(_near(reach)("size", "block", "a_center", "a_radius", "b_center", "b_radius"))
    pairs = written(met.groupBy("a_tile", "b_tile").agg(F.expr("bit_or(shiftleft(1L, block))").alias("mask")), "tile_pairs")
    side = lambda x: tiles.select(F.col("tile").alias(f"{x}_tile"), "size", *(F.col(c).alias(f"{x}_{c}") for c in ("rows", "counts", "raw")))
    both = pairs.join(side("a"), "a_tile").join(side("b").drop("size"), "b_tile")
    both = both.select("size", "mask", (F.col("a_tile") == F.col("b_tile")).alias("same"), "a_rows", "a_counts", "b_rows", "b_counts", "a_raw", "b_raw")
    found = written(both.mapInArrow(_links(cosine), "row long, links long, root long"), "links")

    label = components(reps.select(F.col("row").alias("id"), F.col("row").alias("comp")), found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    known = classes.select(F.col("rep").alias("id"), "c").join(label, "id").join(links.withColumnRenamed("row", "id"), "id", "left")
    known = known.select(F.col("id").alias("rep"), "c", "comp", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"))
    known = lookup(member, written(known, "known"), ["rep"], n, F.col("row")).select("row", "comp", "n_links")
    x = rows.select("row", "vec_id").join(known, "row", "left").select("row", "vec_id", F.coalesce("comp", "row").alias("comp"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    x = written(x, "rows")
    first = written(x.groupBy("comp").agg(F.count("*").alias("c"), F.min("vec_id").alias("component_id")), "first")
    out = lookup(x, first, ["comp"], x.count(), F.col("row"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
