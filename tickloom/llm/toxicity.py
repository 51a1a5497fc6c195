"""Toxicity by non-negative positive-unlabelled learning.

Only texts that were confirmed as toxic carry a label; the others are unlabelled and hold toxic ones too. The
risk of a linear model is pi R_P(+) + max(0, R_U(-) - pi R_P(-)), with pi the share of toxic texts and the
last bracket the risk on clean texts, corrected for what hides among the unlabelled; where a step makes it
negative, it is pushed back up instead. Features are the hashed words of a whole text and their
beginnings, so inflected forms share weight. A feature counts up to MOST times per text, and only features that are commoner in toxic
texts take part, so that long clean texts don't add up small weights. Which ones they are follows from counts over all
documents and all confirmed toxic ones that aren't held out; weights are then fitted on a sample. The best ones get weights of
their own; the other clear ones, and those that the sample hardly holds, share one, which multiplies the log of the ratio of their rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import held_out, some
from .store import written
from .tables import summed
from .words import text_buffers, words

BITS, MOST = 20, 4
#: The feature whose count is the binary order of a text's length: a chance hit means less in a long text.
LENGTH = (1 << BITS) - 1
HEADS = (4, 5, 6, 7, 8, 9, 10)
#: Bounds of the training sample, in documents, and features with a weight of their own.
POSITIVE, UNLABELLED, FEATURES = 1500, 3500, 1024
#: A feature that fewer sampled toxic texts have is not fitted by itself.
LEAST = 5
#: Beyond the best, features take part that are so many times commoner in toxic texts.
CLEAR = 50


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, feature numbers, repeats included) of each text."""
    data, off = text_buffers(column)
    for i, j, at, hashes, _ in words(data, off, lower=True, heads=HEADS):
        f = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in hashes], 1) if len(hashes[0]) else np.zeros((0, 1 + len(HEADS)), np.int32)
        for r in range(j - i):
            yield i + r, f[at[r] : at[r + 1]].ravel()


def _counted(f: np.ndarray) -> np.ndarray:
    """Distinct features with their counts, MOST at most, as feature + (count << BITS), and LENGTH with its class."""
    u, n = np.unique(f[f != LENGTH], return_counts=True)
    return np.append(u + (np.minimum(n, MOST) << BITS), LENGTH + (len(f).bit_length() << BITS)).astype(np.int32)


def choose(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features to learn from, sorted, LENGTH last; the log of the ratio of their rates in toxic and in clean texts; which are the best.

    p, u: texts that have each feature among n_p toxic and n_u unlabelled ones.
    """
    some_of = np.append(np.flatnonzero(p[:LENGTH] >= LEAST), LENGTH)  # features that few toxic texts have stay out
    p, u = p[some_of] / max(1, n_p), u[some_of] / max(1, n_u)
    # unlabelled texts hold toxic ones at the rate of the prior; what is left is the rate in clean texts
    clean = np.maximum(u - prior * p, 0)
    # and so do those that are commoner in them by chance
    z = (p - clean) / np.sqrt(clean / max(1, n_p) + clean / max(1, n_u) + 1.0 / max(1, n_p) ** 2)
    gain = np.where((z > 5) & (p > 4 * clean), p * np.log((p + 2e-3) / (clean + 2e-3)), 0)
    gain[-1] = 0
    best = np.zeros(len(gain), bool)
    best[np.argsort(-gain, kind="stable")[:FEATURES]] = True
    best &= gain > 0
    chosen = best | ((gain > 0) & (p > CLEAR * clean))
    best[-1] = chosen[-1] = True
    return some_of[chosen], np.log((p[chosen] + 1 / max(1, n_u)) / (clean[chosen] + 1 / max(1, n_u))), best[chosen]


def fit(toxic: list[np.ndarray], plain: list[np.ndarray], chosen: np.ndarray, odds: np.ndarray, best: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights per feature, bias) from the counted features of toxic and of unlabelled texts. Deterministic.

    chosen, odds, best: see choose.
    """
    weights = np.zeros(1 << BITS, np.float32)
    if not toxic or not plain:
        return weights, -4.0
    mask = (1 << BITS) - 1

    at = [[np.searchsorted(chosen, f & mask) for f in rows] for rows in (toxic, plain)]
    seen = np.bincount(np.concatenate(at[0]), minlength=len(chosen))
    own = best & ((seen >= LEAST) | (chosen == LENGTH))
    place = np.cumsum(own) - 1

    def matrix(rows: list[np.ndarray], at: list[np.ndarray]) -> np.ndarray:
        """A column for each feature of its own, and the sum of the log ratios of the others."""
        x = np.zeros((len(rows), own.sum() + 1), np.float32)
        for r, (f, i) in enumerate(zip(rows, at, strict=True)):
            mine = own[i]
            x[r, place[i[mine]]] = f[mine] >> BITS
            x[r, -1] = (odds[i[~mine]] * (f[~mine] >> BITS)).sum()
        return x

    xp, xu = matrix(toxic, at[0]), matrix(plain, at[1])
    start = np.zeros(xp.shape[1])
    start[-1] = 1 / (1 + len(HEADS))  # a word has so many features
    w, b = start.copy(), -2.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        gu, gp = su / len(su), -prior * sp / len(sp)  # of the risk on clean texts
        if negative >= 0:
            gp = gp + prior * (sp - 1) / len(sp)
            sign = 1.0
        else:
            sign = -1.0
        g = sign * np.append(xp.T @ gp + xu.T @ gu, gp.sum() + gu.sum())
        g[:-1] += decay * (w - start)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    weights[chosen[own]] = w[:-1]
    weights[chosen[~own]] = w[-1] * odds[~own]
    return weights, float(b)


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """Chooses features by all documents and fits on at most `positive` confirmed toxic and `unlabelled` other ones.

    No label that is held out counts, and no document that is held out is fitted on. The prior is the share of toxic rows among the labels that aren't held out. labels: doc_id, toxic.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out())
    n, k = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    prior = min(0.9, max(0.01, (k or 0) / n)) if n else 0.1
    toxic = written(known.where("toxic = 1").select("doc_id").distinct(), "toxic")  # few ids go to all tasks, by their size
    size, mask = 1 << BITS, (1 << BITS) - 1

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for _, f in _features(batch.column(0)):
            table[np.unique(f[f != LENGTH])] += 1
            table[LENGTH] += 1  # the number of texts

    p, u = (summed(x.select("text"), size, fill) for x in (docs.join(toxic, "doc_id", "left_semi"), docs))
    chosen, odds, best = choose(p, u, int(p[LENGTH]), int(u[LENGTH]), prior)

    yes = some(toxic, positive, 1).withColumn("toxic", F.lit(True))
    any_ = some(docs.select("doc_id"), unlabelled, 2).distinct().withColumn("plain", F.lit(True))
    ids = written(yes.join(any_, "doc_id", "full_outer"), "sample")  # at most positive + unlabelled rows
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", "plain", "doc_id")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for _, f in _features(batch.column(0)):
                f = _counted(f)
                got.append(f[np.isin(f & mask, chosen)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(1), batch.column(2), pa.array(got, pa.binary())], names=["doc_id", "toxic", "plain", "f"])

    # rows that repeat a doc_id count once, so that the sample is bounded
    got = rows.mapInArrow(sample, "doc_id long, toxic boolean, plain boolean, f binary").groupBy("doc_id", "toxic", "plain").agg(F.max("f").alias("f")).collect()
    sets = lambda name: [np.frombuffer(x, np.int32) for x in sorted(bytes(r["f"]) for r in got if r[name])]
    return fit(sets("toxic"), sets("plain"), chosen, odds, best, prior)


def _scores(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(column), bias)
    for r, f in _features(column):
        out[r] += weights[LENGTH] * len(f).bit_length()
        if len(f):
            hit = f[(weights[f] != 0) & (f != LENGTH)]
            if len(hit):
                u, n = np.unique(hit, return_counts=True)
                out[r] += (weights[u] * np.minimum(n, MOST)).sum()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts get the score of a text without features. Repeated rows stay; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), *shared.value))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; columns are unchanged.

    Only texts go to Python and only verdicts come back; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array(_scores(text, *shared.value) < threshold)

    return docs.where(clean("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row of docs."""
    x = score(docs, train(docs, labels))
    return x.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
