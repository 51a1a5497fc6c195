"""Text quality from random-indexing word vectors and a small network.

Every word, and every word ending, has a sparse random index vector; its context vector is the sum of the
index vectors of its left and right neighbours over all texts (random indexing). The vectors live in a hashed table
of fixed size that tasks fill and Spark adds up. A document is pooled into the mean and the spread of its
context vectors and their length; a two-layer network in numpy gives a logit, and a temperature fitted on rows kept
back from training calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import held_out, some
from .tables import summed
from .words import text_buffers, words

SLOT_BITS, DIM, TAIL = 14, 24, 3
#: Labelled documents that the network learns from, at most.
LABELLED = 20_000
WIDTH = 4 * DIM + 3


def _units(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Table rows of words and of their endings."""
    return [(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64) + (k << SLOT_BITS) for k, h in enumerate(hashes)]


def _fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
    """Adds the index vectors of all neighbours in the batch's texts: two places of +1 or -1 for each neighbour."""
    data, off = text_buffers(batch.column(0))
    for _, _, at, hashes, _ in words(data, off, heads=(-TAIL,)):
        n = len(hashes[0])
        if n < 2:
            continue
        inside = np.ones(n - 1, bool)
        edges = at[1:-1] - 1
        inside[edges[(edges >= 0) & (edges < n - 1)]] = False  # no neighbours across texts
        h, keep = hashes[0], np.flatnonzero(inside)
        for units in _units(hashes):
            for here, there, shift in ((keep, keep + 1, 0), (keep + 1, keep, 20)):  # right and left neighbours have index vectors of their own
                x = h[there]
                for s in (shift, shift + 10):
                    place = ((x >> np.uint64(s)) & np.uint64(0x1FF)).astype(np.int64) % DIM
                    sign = ((x >> np.uint64(s + 9)) & np.uint64(1)).astype(np.float64) * 2 - 1
                    table += np.bincount(units[here] * DIM + place, sign, len(table))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors, (2 ** (SLOT_BITS + 1), DIM), from all texts."""
    table = summed(docs.select("text"), (2 << SLOT_BITS) * DIM, _fill).reshape(-1, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of WIDTH features for each text; zeros if it has no words."""
    out = np.zeros((len(column), WIDTH), np.float32)
    data, off = text_buffers(column)
    for i, j, at, hashes, size in words(data, off, heads=(-TAIL,)):
        full = np.flatnonzero(at[1:] > at[:-1])
        if not len(full):
            continue
        starts, n = at[:-1][full], (at[1:] - at[:-1])[full][:, None].astype(np.float32)
        for k, units in enumerate(_units(hashes)):
            mean, square = np.zeros((len(full), DIM), np.float32), np.zeros((len(full), DIM), np.float32)
            if len(units) <= 1 << 18:
                x = vectors[units]
                mean = np.add.reduceat(x, starts, 0) / n
                square = np.add.reduceat(x * x, starts, 0) / n
            else:  # one long text
                for p in range(0, len(units), 1 << 18):
                    x = vectors[units[p : p + (1 << 18)]]
                    mean += x.sum(0) / n
                    square += (x * x).sum(0) / n
            out[i + full, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[i + full, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
            out[i + full, 4 * DIM + k] = np.linalg.norm(mean, axis=1)
        out[i + full, 4 * DIM + 2] = np.log1p(n[:, 0]) / 8
    return out


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> dict[str, np.ndarray]:
    """The network's weights and temperature. A fifth of the rows is kept back for the temperature. Deterministic."""
    rng = np.random.default_rng(seed)
    n = len(y)
    if n < 10 or y.min() == y.max():
        rate = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
        return {"mu": np.zeros(WIDTH), "sd": np.ones(WIDTH), "a": np.zeros((WIDTH, 1)), "b": np.zeros(1), "c": np.zeros(1), "d": np.array([np.log(rate / (1 - rate))]), "t": np.ones(1)}
    order = rng.permutation(n)
    back, order = order[: n // 5], order[n // 5 :]
    mu, sd = x[order].mean(0), x[order].std(0) + 1e-4
    z = (x - mu) / sd
    p = [rng.normal(0, np.sqrt(2 / WIDTH), (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        rate = 0.004 * 0.95**epoch
        rng.shuffle(order)
        for s in range(0, len(order), 64):
            rows = order[s : s + 64]
            u = z[rows] @ p[0] + p[1]
            r = np.maximum(u, 0)
            g = (1 / (1 + np.exp(-np.clip(r @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back_ = np.outer(g, p[2]) * (u > 0)
            grads = [z[rows].T @ back_ + 1e-3 * p[0], back_.sum(0), r.T @ g + 1e-3 * p[2], np.array([g.sum()])]
            t += 1
            for q in range(4):
                m[q] = 0.9 * m[q] + 0.1 * grads[q]
                v[q] = 0.999 * v[q] + 0.001 * grads[q] ** 2
                p[q] -= rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    logit = np.maximum(z[back] @ p[0] + p[1], 0) @ p[2] + p[3]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, logit / k) - y[back] * logit / k) for k in grid]
    return {"mu": mu, "sd": sd, "a": p[0], "b": p[1], "c": p[2], "d": p[3], "t": np.array([grid[int(np.argmin(loss))]])}


def probability(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    logit = np.maximum((x - net["mu"]) / net["sd"] @ net["a"] + net["b"], 0) @ net["c"] + net["d"]
    return 1 / (1 + np.exp(-np.clip(logit / net["t"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Word vectors from all texts and a network from at most `most` labelled documents that aren't held out."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    known = some(labels.select("doc_id", "quality").where(F.col("quality").isNotNull()).distinct(), most, 3)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")
    # rows that repeat a doc_id count once, so that the sample is bounded
    rows = rows.mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.max("x").alias("x"))
    got = sorted((r[0], r[2], r[1]) for r in rows.collect())
    x = np.array([np.frombuffer(r[1], np.float32) for r in got], np.float32).reshape(-1, WIDTH)
    return vectors, fit(x.astype(np.float64), np.array([r[2] == 1 for r in got], float))


def score(docs: DataFrame, model: tuple[np.ndarray, dict[str, np.ndarray]]) -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text; other columns are ignored).

    Null, empty and blank texts get the score of the zero vector. Repeated rows stay; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column(1), shared.value[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(x, shared.value[1]))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row of docs."""
    x = score(docs, train(docs, labels))
    return x.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
