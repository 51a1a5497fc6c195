"""Merkle manifest of a table: a tree for each source and one over the sources, with nested-interval labels.

A leaf is the digest of a document; leaves are ranked inside their source by doc_id. Every node carries the
interval of leaf ranks that it covers, so a node is an ancestor of a leaf if its interval holds the leaf's rank, and
the siblings at a step are a parent's children less the one whose interval holds it. Ancestors are attached by joins on level
buckets: BAND levels make a band, a band is cut into subtrees, and a subtree's nodes meet what lies below it on (tree, number of the
subtree). Bands are joined from the top, so that a subtree passes on the whole path above it.

Ranks come from rows dealt by ranges and running counts of the ranges, so no task gets a whole source; a bucket has at most
ARITY ** BAND members, whatever the size of a source. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import sized, written

ARITY, BAND = 3, 4
WIDTH = ARITY**BAND
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>)"


def leaf_digest(text: Column | None = None) -> Column:
    """Lowercase hex SHA-256 of a document's columns: '-' for null, else UTF-8 byte count, ':' and the value. text: instead of the column."""
    parts = []
    for name in COLUMNS:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def ranked(x: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """x with `lo` (place from 0 among the rows of its tree), `hi` (lo + 1) and `height` (of the tree).

    Rows are dealt by ranges of (tree, order), so a tree may span many tasks; a small table of counts by range gives where
    each range begins. Rows that are equal in all of these may swap places.
    """
    x = x.withColumn("_tie", F.monotonically_increasing_id())  # equal rows too are dealt over several ranges
    keys = [F.col(tree), *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    x = x.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_m", F.monotonically_increasing_id())
    x = written(x, "ranked").withColumn("_p", F.shiftright("_m", 33))
    inside = Window.partitionBy(tree).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    starts = x.groupBy(tree, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_c"))  # a row for each range and tree
    starts = starts.withColumn("_before", F.sum("_c").over(inside) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(tree)))
    height = sum((F.when(F.col("_n") > ARITY**l, 1).otherwise(0) for l in range(1, 39)), F.when(F.col("_n") > 1, 1).otherwise(0))
    starts = written(starts.select(tree, "_p", "_first", "_before", height.alias("height")), "starts")
    lo = (F.col("_m") - F.col("_first") + F.col("_before")).alias("lo")
    return x.join(sized(starts), [tree, "_p"]).select("*", lo, (lo + 1).alias("hi")).drop("_m", "_p", "_first", "_before")


def build(points: DataFrame) -> list[DataFrame]:
    """The bands of a forest from the bottom: (tree, bucket, lo, hi, digest, nodes), a row for each subtree of BAND levels.

    points: tree, lo, hi, digest, height. nodes: (lo, hi, digest, kids) of every node of the subtree, low levels first;
    lo, hi and digest are those of its top. A level is made while its tree has several nodes.
    """
    highest = points.agg(F.max("height")).first()[0]
    bands, b = [], 0
    while highest is not None and (b == 0 or b * BAND < highest):
        x = points.groupBy("tree", F.expr(f"lo div {WIDTH ** (b + 1)}L").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("l0"), F.max("height").alias("height"))
        for s in range(1, BAND + 1):
            run = f"slice(l{s - 1}, CAST({ARITY} * j + 1 AS INT), {ARITY})"
            node = f"""named_struct('lo', {run}[0].lo, 'hi', element_at({run}, -1).hi, 'digest', sha2(array_join(transform({run}, c -> c.digest), ''), 256),
                'kids', transform({run}, c -> named_struct('lo', c.lo, 'hi', c.hi, 'digest', c.digest)))"""
            x = x.withColumn(f"l{s}", F.expr(f"IF(height < {b * BAND + s}, array(), transform(sequence(0, CAST((size(l{s - 1}) - 1) div {ARITY} AS INT)), j -> {node}))"))
        top = lambda name: F.coalesce(*(F.get(f"l{s}", F.lit(0))[name] for s in range(BAND, -1, -1))).alias(name)  # noqa: B023, E731
        x = x.select("tree", "bucket", "height", top("lo"), top("hi"), top("digest"), F.concat(*(f"l{s}" for s in range(1, BAND + 1))).alias("nodes"))
        bands.append(written(x, "band"))
        points, b = bands[-1], b + 1
    return bands


def siblings(nodes: str, lo: str, hi: str) -> Column:
    """(left, right) digests of the siblings at each step, from the nodes whose interval holds [lo, hi), low levels first."""
    side = lambda test: f"array_join(transform(filter(a.kids, c -> {test}), c -> c.digest), '')"
    return F.expr(f"transform(filter({nodes}, a -> a.lo <= {lo} AND {hi} <= a.hi), a -> named_struct('left', {side(f'c.hi <= {lo}')}, 'right', {side(f'c.lo >= {hi}')}))")


def attach(points: DataFrame, bands: list[DataFrame], roots: DataFrame) -> DataFrame:
    """points with `path`, the siblings up to the root of their tree and on along the path of roots, and the other columns of roots.

    roots: tree, path and other columns, a row for each tree.
    """
    also = [c for c in roots.columns if c not in ("tree", "path")]
    state = bands[-1].join(roots, "tree")
    for below in [*bands[-2::-1], points.withColumn("bucket", F.col("lo"))]:
        up = state.select("tree", F.col("bucket").alias("_up"), F.col("nodes").alias("_nodes"), F.col("path").alias("_path"), *also)
        by = f"bucket div {WIDTH}L"
        state = below.withColumn("_up", F.expr(by)).join(up, ["tree", "_up"])
        state = state.withColumn("path", F.concat(siblings("_nodes", "lo", "hi"), "_path")).drop("_up", "_nodes", "_path")
    return state.drop("bucket")


def fold(leaf: str) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.expr(f"aggregate(path, {leaf}, (h, s) -> sha2(concat(s.left, h, s.right), 256))")


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, seen, subroot, root, path of each row of docs.

    docs: doc_id, text, lang, source, n_chars; other columns are ignored. changed: the text to be checked, of those who hold
    it; seen is the leaf that it gives (leaf itself without). path: (left, right), the digests beside the leaf's own at each step up to the
    root, subroots included. A null source is a source of its own and comes first; null doc_ids come first in their source; rows
    that share a doc_id follow by leaf, and equal rows take their places in any order. A source of one row has its leaf as subroot, a table of one source
    its subroot as root. An empty table gives an empty result.
    """
    x = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), leaf_digest().alias("digest"),
        (F.lit(None).cast("string") if changed is None else F.when(~changed.eqNullSafe(F.col("text")), leaf_digest(changed))).alias("seen"),
    )
    points = ranked(written(x, "leaves"), "tree", ["doc_id", "digest"])
    bands = build(points)
    if not bands:
        return points.select("doc_id", F.lit(None).cast("string").alias("source"), F.col("digest").alias("leaf"), "seen", *(F.lit(None).cast("string").alias(c) for c in ("subroot", "root")), F.expr(_NO_PATH).alias("path"))
    # the sources' roots are the leaves of one more tree
    tops = bands[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    tops = written(ranked(tops, "tree", ["of"]), "tops")
    over = build(tops)
    whole = over[-1].select("tree", F.expr(_NO_PATH).alias("path"), F.col("digest").alias("root"))
    roots = attach(tops, over, whole).select(F.col("of").alias("tree"), "path", "root", F.col("digest").alias("subroot"))
    out = attach(points, bands, written(roots, "roots"))
    return out.select("doc_id", F.expr("IF(tree = '', NULL, substr(tree, 2))").alias("source"), F.col("digest").alias("leaf"), F.coalesce("seen", "digest").alias("seen"), "subroot", "root", "path")


def audit(entries: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified from manifest(): whether what is seen still gives the root."""
    proof = F.expr("sha2(array_join(transform(path, s -> concat(s.left, s.right)), ''), 256)")
    x = entries.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold("seen").alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))
