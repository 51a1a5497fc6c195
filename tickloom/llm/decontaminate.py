"""Benchmark passages inside long documents: size-partitioned MinHash containment search, exact verification.

A MinHash signature of a whole long document says little about a passage of thirty words in it, so what is signed
follows the size of what is looked for. Items are partitioned by the size of their shingle set, in powers of two. For
each partition a document is cut into tiles of half the partition's least size, and a tile's signature
under a hash function is the least hash of its shingles. For an item of q shingles, of which the share t lies in a
document, in one place or many, a function gives some tile the item's own signature with a chance of at least
t q / (q + w - 1), w being the tile's size. Each partition takes as many functions as make the chance that all of them
miss smaller than MISS. Equal signatures make a candidate, and a candidate is verified by counting the item's shingles in
the whole document, so what is returned is exact and what can be missed is one match in 1 / MISS at most. Documents
are read once and never shuffled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import mix, shingle_blocks, shingle_sets, text_buffers, words

#: Items go to the executors in blocks of so many bytes of text at most (or one item); each block is one pass over the documents.
BLOCK_BYTES = 32 << 20
#: The chance that a match becomes no candidate, at most.
MISS = 1e-9


@functools.lru_cache(1 << 14)
def _family(f: int) -> tuple[np.uint64, np.uint64]:
    """Hash function f: (x ^ a) * b modulo 2**64, one to one on shingle hashes; as many as are asked for."""
    a, b = mix(np.array([2 * f + 1, 2 * f + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return a, b | np.uint64(1)


def signatures(s: np.ndarray, f: int) -> np.ndarray:
    a, b = _family(f)
    return (s ^ a) * b


def functions(q: int, w: int, num: int, den: int, miss: float = MISS) -> int:
    """Hash functions that find an item of q shingles, num/den of them in tiles of w, but for a chance of miss."""
    hit = -(-num * q // den) / (q + w - 1)
    return 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))


def make_index(items: list[tuple[int | None, str]], k: int, num: int, den: int, miss: float = MISS) -> dict:
    """Items with their shingle sets, and for each size partition its tile and the items by signature.

    short: for each number of words below k, the hashes of the items of so many words, sorted, and the items.
    """
    texts = pa.array([t for _, t in items], pa.string())
    size = np.concatenate([np.zeros(0, np.int64), *(np.diff(at) for _, _, at, _, _ in words(*text_buffers(texts)))])
    found = [(items[r][0], u, int(size[r])) for r, u in shingle_sets(texts, k) if len(u)]
    ids, sets = [i for i, *_ in found], [u for _, u, _ in found]
    members: dict[int, list[int]] = {}
    few: dict[int, list[int]] = {}
    for i, (_, u, n) in enumerate(found):
        if n < k:
            few.setdefault(n, []).append(i)
        else:
            members.setdefault(len(u).bit_length(), []).append(i)
    short = {}
    for n, own in sorted(few.items()):
        own = np.array(own)[np.argsort([sets[i][0] for i in own], kind="stable")]
        short[n] = np.array([sets[i][0] for i in own], np.uint64), own
    parts = []
    for _, own in sorted(members.items()):
        q = min(len(sets[i]) for i in own)
        tile, tables = max(1, q // 2), []
        for f in range(functions(q, tile, num, den, miss)):
            signed = np.array([signatures(sets[i], f).min() for i in own], np.uint64)
            order = np.argsort(signed, kind="stable")
            bits = len(own).bit_length() + 6
            some = np.zeros(1 << bits, bool)  # which leading bits occur, a quick first test
            some[(signed >> np.uint64(64 - bits)).astype(np.int64)] = True
            tables.append((signed[order], np.array(own)[order], some, np.uint64(64 - bits)))
        parts.append((tile, tables))
    return {"k": k, "ids": ids, "sets": sets, "need": [-(-num * len(u) // den) for u in sets], "parts": parts, "short": short}


def candidates(parts: list, bounds: np.ndarray, s: np.ndarray) -> np.ndarray:
    """(row, item) pairs that share a signature, of rows with shingles s[bounds[r] : bounds[r + 1]]."""
    size, pairs = np.diff(bounds), [np.zeros((0, 2), np.int64)]
    for tile, tables in parts if len(s) else []:
        n = -(-size // tile)
        row = np.repeat(np.arange(len(n)), n)
        begin = np.concatenate([[0], np.cumsum(n)])
        starts = bounds[row] + (np.arange(len(row)) - begin[row]) * tile
        for f, (signed, owner, some, shift) in enumerate(tables):
            least = np.minimum.reduceat(signatures(s, f), starts)
            at = np.flatnonzero(some[(least >> shift).astype(np.int64)])
            lo, hi = np.searchsorted(signed, least[at], "left"), np.searchsorted(signed, least[at], "right")
            for t, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                pairs.append(np.stack([np.full(b - a, row[t]), owner[a:b]], 1))
    return np.unique(np.concatenate(pairs), axis=0)


def search(index: dict, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, its shingles, shared ones) for the items that a text holds well enough; items by their place in ids."""
    for i, _, bounds, s in shingle_blocks(column, index["k"]):
        last, u = -1, s[:0]
        for r, item in candidates(index["parts"], bounds, s):
            if r != last:
                last, u = r, np.unique(s[bounds[r] : bounds[r + 1]])
            own = index["sets"][item]
            at = np.searchsorted(u, own)
            at[at == len(u)] = 0
            shared = int((u[at] == own).sum())
            if shared >= index["need"][item]:
                yield int(i + r), int(item), len(own), shared
    # items of fewer words than a shingle, anywhere in a text; the number of words is part of a shingle's hash
    for n, (signed, owner) in index["short"].items():
        for i, _, bounds, s in shingle_blocks(column, n):
            at = np.flatnonzero(signed[np.searchsorted(signed, s) % len(signed)] == s)
            row = np.searchsorted(bounds, at, "right") - 1
            for r, x in sorted(set(zip(row.tolist(), s[at].tolist(), strict=True))):
                lo, hi = np.searchsorted(signed, np.uint64(x), "left"), np.searchsorted(signed, np.uint64(x), "right")
                for item in owner[lo:hi]:
                    yield int(i + r), int(item), 1, 1


def _blocks(bench: DataFrame, size: int) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """The items in lists of texts of at most `size` bytes, or of one item, and whether the list is the last one. One list at least."""
    rows: list[tuple[int | None, str]] = []
    held = 0
    for item, text in bench.toLocalIterator():
        n = len(text.encode())
        if rows and held + n > size:
            yield rows, False
            rows, held = [], 0
        rows.append((item, text))
        held += n
    yield rows, True


def _items(bench: DataFrame) -> DataFrame:
    return bench.select("item_id", "text").where("text is not null").distinct()


def leaks(docs: DataFrame, bench: DataFrame, k: int = 5, num: int = 80, den: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): items of which num/den of the shingles or more lie in a document.

    docs: doc_id, text; bench: item_id, text; other columns are ignored. k-word shingles with A-Z lower-cased; an
    item of fewer words is one shingle and is found wherever a text holds these words in a row. Null, empty and blank texts match nothing.
    Repeated documents each give rows, repeated items give one row per pair, null ids stay null. Items are read in blocks of
    block_bytes, so what the driver and tasks hold is bounded by that or by the longest item however large bench is;
    documents take one pass per block. Empty tables give an empty result.
    """
    docs = docs.select("doc_id", "text")
    sc, parts = docs.sparkSession.sparkContext, []
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())])
    for items, last in _blocks(_items(bench), block_bytes):
        index = sc.broadcast(make_index(items, k, num, den))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            for batch in batches:
                ids = batch.column(0)
                rows = [(ids[r].as_py(), x["ids"][i], n, shared) for r, i, n, shared in search(x, batch.column(1))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        found = docs.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long")
        if last and not parts:
            return found
        parts.append(written(found, "leaks"))
        index.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _holds_none(index):
    @F.arrow_udf("boolean")
    def verdict(text: pa.Array) -> pa.Array:
        keep = np.ones(len(text), bool)
        for r, *_ in search(index.value, text):
            keep[r] = False
        return pa.array(keep)

    return verdict


def clean(docs: DataFrame, bench: DataFrame, k: int = 5, num: int = 80, den: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text leaks an item; columns and other rows are unchanged.

    Decided row by row inside the pass: only texts go to Python and only verdicts come back, and nothing is joined or
    shuffled; rows without doc_id count too. Beyond one block of items the rows that are left are written after each.
    """
    sc = docs.sparkSession.sparkContext
    for items, last in _blocks(_items(bench), block_bytes):
        index = sc.broadcast(make_index(items, k, num, den))
        docs = docs.where(_holds_none(index)("text"))
        if not last:
            docs = written(docs, "clean")
            index.destroy()
    return docs
