"""Vectorized 64-bit hashes of words and shingles, straight from Arrow string buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so words of UTF-8 text are found without
decoding it. A word's hash is a polynomial over its bytes modulo 2**64, mixed at the end; sums over
prefixes give all hashes of a block in a few passes. Long texts are hashed in blocks that end at
white space, so memory follows the block and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240607))
_exact = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_lower = _exact.copy()
_lower[65:91] = _exact[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
COEF = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        n = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of each uint64 over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def _block(buf: np.ndarray, first: np.ndarray, last: np.ndarray, table: np.ndarray, heads: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Starts and hashes of the words in buf. Rows begin at first and end before last. heads: also hash the first k bytes, or the last -k."""
    space = SPACE[buf]
    at = ~space
    begins = at.copy()
    begins[1:] &= space[:-1]
    begins[first] = at[first]
    ends = at.copy()
    ends[:-1] &= space[1:]
    ends[last - 1] = at[last - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[buf] * up[: len(buf)], out=sums[1:])
    base, scale = sums[starts], down[starts]
    out = [mix((sums[stops] - base) * scale)]
    for k in heads:
        if k > 0:
            out.append(mix((sums[np.minimum(stops, starts + k)] - base) * scale + np.uint64(k)))
        else:
            tail = np.maximum(starts, stops + k)
            out.append(mix((sums[stops] - sums[tail]) * down[tail] + np.uint64(256 - k)))
    return starts, out, stops - starts


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, heads: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Yields (i, j, at, hashes, lengths): of rows i to j, row i + r has words at[r] to at[r + 1].

    hashes[0] are the words' hashes, hashes[1:] those of their first k bytes (last -k if negative) for k in heads;
    lengths are in bytes. lower: A-Z count as a-z.
    """
    table, i, n = _lower if lower else _exact, 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= BLOCK:
            if hi == lo:
                yield i, j, np.zeros(j - i + 1, np.int64), [np.zeros(0, np.uint64)] * (1 + len(heads)), np.zeros(0, np.int64)
            else:
                rows = off[i : j + 1] - lo
                full = rows[1:] > rows[:-1]
                starts, out, size = _block(data[lo:hi], rows[:-1][full], rows[1:][full], table, heads)
                yield i, j, np.searchsorted(starts, rows), out, size
        else:
            parts, sizes = [], []
            while lo < hi:
                cut = min(lo + BLOCK, hi)
                while cut < hi:  # to the next white space
                    if (gap := np.flatnonzero(SPACE[data[cut : min(hi, cut + BLOCK)]])).size:
                        cut += int(gap[0])
                        break
                    cut = min(hi, cut + BLOCK)
                _, out, size = _block(data[lo:cut], np.array([0]), np.array([cut - lo]), table, heads)
                parts.append(out)
                sizes.append(size)
                lo = cut
            yield i, j, np.array([0, sum(map(len, sizes))]), [np.concatenate(x) for x in zip(*parts, strict=True)], np.concatenate(sizes)
        i = j


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text, repeats included; of the whole text if it has fewer words."""
    n = len(hashes)
    if not n:
        return hashes
    m = min(n, k)
    total = np.full(n - m + 1, np.uint64(m), np.uint64)
    for x in range(m):
        total += hashes[x : n - m + 1 + x] * COEF[x]
    return mix(total)


def shingle_blocks(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bounds, s): row i + r has the shingle hashes s[bounds[r] : bounds[r + 1]], A-Z lower-cased, repeats included."""
    data, off = text_buffers(column)
    for i, j, at, (h,), _ in words(data, off, lower=True):
        n = at[1:] - at[:-1]
        many = n >= k
        size = np.where(many, n - k + 1, n > 0)
        bounds = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(bounds[-1], np.uint64)
        if many.any():
            every = shingles(h, k)  # also those that cross two rows, which are left out
            first = np.repeat(at[:-1][many] - np.concatenate([[0], np.cumsum(size[many])[:-1]]), size[many])
            out[np.repeat(many, size)] = every[first + np.arange(len(first))]
        for r in np.flatnonzero((n > 0) & ~many):
            out[bounds[r]] = shingles(h[at[r] : at[r + 1]], k)[0]
        yield i, j, bounds, out


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text, A-Z lower-cased."""
    for i, j, bounds, s in shingle_blocks(column, k):
        for r in range(j - i):
            yield i + r, np.unique(s[bounds[r] : bounds[r + 1]])
