"""Merkle manifest, embedding join and filter audit against brute force, on edges, ties and hot keys."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import filter_audit, merkle, vector_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, lo long, part string, c long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def docs(spark, rows):
    """rows: doc_id, text, lang, source, n_chars; extra columns are named as the operators' own."""
    return spark.createDataFrame([(*r, "t", 1, "p", 2) for r in rows], DOCS)


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_paths(level):
    """The root over digests and for each one the (left, right) siblings up to it."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, pos in enumerate(at):
            run, i = runs[pos // 3], pos % 3
            paths[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
            at[k] = pos // 3
        level = [sha(*r) for r in runs]
    return level[0], paths


def brute_manifest(rows, changed):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in keys:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = own, *tree_paths([leaf(*r) for r in own])
    root, over = tree_paths([trees[s][1] for s in keys])
    out = []
    for s, above in zip(keys, over, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            path = path + above
            h = leaf(r[0], changed(r), *r[2:])
            for a, b in path:
                h = sha(a, h, b)
            out.append((r[0], leaf(*r), subroot, root, sha(*(a + b for a, b in path)), h, h == root))
    return sorted(map(str, out))


def untouched(r):
    return r[1]


def without_breaks(r):
    return r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]


def breaks():
    """What without_breaks does, as a column."""
    return F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def manifest_rows(x):
    return sorted(str(tuple(r)) for r in merkle.audit(x).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [4, 3, 9], [300, 82, 1, 28]])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(1000 * s + i, f"line {i}\nmore é" if i % 3 else None, "en" if i % 2 else None, f"s{s}" if s else None, i if i % 5 else None) for s, n in enumerate(sizes) for i in range(n)]
    assert manifest_rows(merkle.manifest(docs(spark, rows), breaks())) == brute_manifest(rows, without_breaks)


def test_manifest_ties_nulls_and_long_texts(spark):
    rows = [(5, "a\nb", "en", "s", 1)] * 7 + [(5, "c", "en", "s", 1), (None, "x\ny", None, "s", None), (None, None, None, None, None), (6, "", "", "", 0), (7, "word " * 100_000 + "\n", "en", "ü", 9)]
    assert manifest_rows(merkle.manifest(docs(spark, rows), breaks())) == brute_manifest(rows, without_breaks)
    assert manifest_rows(merkle.manifest(docs(spark, rows))) == brute_manifest(rows, untouched)
    assert merkle.audit(merkle.manifest(docs(spark, []), breaks())).collect() == []


def test_ranks_of_a_source_span_several_ranges(spark):
    x = spark.range(5000).select(F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("tree"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("k"))
    got = merkle.ranked(x, "tree", ["k"]).collect()
    for tree, n in (("a", 1250), ("b", 3750)):
        own = sorted((r["lo"], r["k"]) for r in got if r["tree"] == tree)
        assert [lo for lo, _ in own] == list(range(n)) and [k for _, k in own] == sorted(k for _, k in own)


VECTORS = "vec_id long, embedding array<float>, label int, row long, unit string"


def brute_vectors(rows, cosine):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return sorted(str((v, links[i], least.get(find(i)), v == least.get(find(i)))) for i, (v, _) in enumerate(rows))


def vector_rows(spark, rows, cosine=0.9):
    x = spark.createDataFrame([(i, v, 1, 2, "u") for i, v in rows], VECTORS)
    return sorted(str(tuple(r)) for r in vector_join.vector_components(x, cosine).select("vec_id", "n_links", "component_id", "kept").collect())


@pytest.mark.parametrize(("size", "tile"), [(64, 16), (40, 2048), (3, 16)])
def test_vector_components_equal_brute_force(spark, monkeypatch, size, tile):
    monkeypatch.setattr(vector_join, "TILE", tile)
    rng = np.random.default_rng(size)
    base = rng.standard_normal((12, size))
    near = [base[i % 12] + rng.standard_normal(size) * rng.choice([0.05, 0.3, 0.45]) for i in range(150)]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(near)]
    rows += [(500 + i, rows[i % 3][1]) for i in range(9)] + [(3, rows[40][1]), (None, rows[41][1]), (None, [1.0] * size)]
    rows += [(600, None), (601, []), (602, [0.0] * size), (603, [float("nan")] + [1.0] * (size - 1)), (604, [None] + [1.0] * (size - 1)), (605, [float("inf")] * size), (606, [1.0, 2.0]), (607, [2.0, 4.0])]
    rows += [(700, [x * 1e-30 for x in rows[0][1]]), (None, None)]
    assert vector_rows(spark, rows) == brute_vectors(rows, 0.9)


def test_vectors_at_the_threshold_and_empty_table(spark):
    c, s = 0.9, 0.19**0.5
    rows = [(1, [1.0, 0.0]), (2, [c + 1e-4, s]), (3, [c - 1e-4, s]), (4, [-1.0, 0.0])]
    assert vector_rows(spark, rows) == brute_vectors(rows, 0.9)
    assert vector_rows(spark, []) == []


def test_blocks_lose_no_pair():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x = np.concatenate([x, x + rng.standard_normal(x.shape) * 0.48])
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = vector_join.rotation(64)
    assert np.allclose(q @ q.T, np.eye(64))
    i, j = vector_join.compare(x @ q, x @ q, 15, 0.9, True)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) > 50


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, _, source, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i]
        docs.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley, lines = {}, []
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] = shapley.get(f, 0) + len(gone)
                failing = sum(d[1][f] for d in own)
                lines.append((f, ["".join("ABCDE"[x] for x in order), step, len(left), len(gone), failing - len(gone), sum(d[1][f] and sum(d[1]) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]))
        out += [str((part, *line, shapley[f])) for f, line in lines]
    return sorted(out)


def audit_rows(spark, rows, labels):
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(str(tuple(r)) for r in filter_audit.audit(docs(spark, rows), y).select(*columns).collect())


def test_filter_audit_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        w = [f"w{x}" for x in rng.integers(0, rng.choice([20, 4000]), rng.integers(1, 120))]
        t = " ".join(w) + (" #" if rng.random() < 0.2 else "") + (" SHOUT" * 20 if rng.random() < 0.2 else "")
        rows.append((int(i), t, "en", f"s{i % 3}" if i % 7 else None, 1))
    rows += [(1000 + i, rows[i % 5][1], "en", "s0", 1) for i in range(40)] + [(3, rows[9][1], "en", "s1", 1), (9, rows[9][1], "en", "s1", 1), (None, rows[9][1], "en", "", 1)]
    rows += [(None, None, None, None, None), (2000, "", "en", "s1", 1), (2001, None, "en", "s1", 1), (2002, "Long Words " * 60_000, "en", "s2", 1)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 1020, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None)]
    assert audit_rows(spark, rows, labels) == brute_audit(rows, labels)


def test_filter_audit_of_empty_tables(spark):
    assert audit_rows(spark, [], []) == []
    rows = [(1, "a b", "en", "s", 1)]
    assert audit_rows(spark, rows, []) == brute_audit(rows, [])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 31, 1000])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    want = [int(sum(int(w) >> i & 1 for w in words)) for i in range(32)]
    assert filter_audit.positional_counts(words).tolist() == want
    part = np.arange(n) % 3
    got = filter_audit.part_counts(part, words, 4)
    assert [g.tolist() for g in got] == [[int(sum(int(w) >> i & 1 for w in words[part == p])) for i in range(32)] for p in range(4)]
