"""Mixing sources to target weights: exact quotas, a hypergeometric splitting tree and permuted blocks.

Every source is dealt into blocks by the md5 of its doc_id, and of the row's number where an id is missing or shared. Its target is met by whole passes over all
its blocks and one more pass over its blocks in a permuted order until the target is full, to the word.
A tree over the output shards splits the quotas of blocks: at each node a uniformly chosen half of the
node's places, a multivariate hypergeometric draw over the sources, goes to the left. A shard draws its
quota of a source as a range of the source's permuted blocks, so shards are disjoint, and is ordered
inside by a hash. What the mix takes of a document is what the shards draw of it: a block that no shard draws is not
taken. Built-in expressions only. Texts are read once; what is shuffled is a few numbers a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import lookup
from .store import free_name, numbered, written

WS = r"[\x20\x09-\x0D]+"
#: Hex digits of a block (16 ** 2 blocks a source), and documents that a range of running sums may hold.
DIGITS, RANGE_DOCS = 2, 1024


def word_count(text: str):
    """Words [^\\x20\\x09-\\x0D]+ of a text, null 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.size(F.array_remove(F.split(t, WS), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources: (skey, source, source_size), a row for each source. Adds weight, target and quota (whole words).

    Sources by code point, null last, get the weights in turn. The total is share times all sizes; a target
    stops at most times its source's size and the excess is shared by weight among the rest. That is a common
    level: the target is the smaller of the cap and level * weight, and the level follows from the
    sources ordered by cap / weight.
    """
    table = F.array(*map(F.lit, map(float, weights)))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    x = sources.withColumn("i", F.row_number().over(one) - 1).withColumn("weight", F.get(table, F.col("i") % len(weights)))
    x = x.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "i")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    x = x.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest)
    # the first source that its level doesn't fill sets the level of all from there on
    level = F.min_by("level", "at").over(Window.partitionBy())
    x = x.withColumn("at", F.when(F.col("level") <= F.col("ratio"), F.row_number().over(up)))
    x = x.withColumn("level", level)
    x = x.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
    return x.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")).select("skey", "source", "i", "source_size", "weight", "target", "quota")


def splitting_tree(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(node, i, blocks): how many blocks of source i the leaf `node` gets, from (i, blocks); shard = node - shards.

    Every quota is laid out as so many places. At a node the places are put in the order of a hash and the first
    half of them goes left, so that all halves are equally likely and both sides exact: the sources' counts are a
    multivariate hypergeometric draw. Leaves without blocks of a source have no row. The table has a row for each block,
    a few hundred for each source, whatever the number of documents.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    x = counts.where("blocks > 0").select(F.lit(1).cast("long").alias("node"), "i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks").cast("long"))).alias("j"))
    while shards > 1:
        order = Window.partitionBy("node").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "node", "i", "j")))
        left = F.row_number().over(order) <= F.floor(F.count("*").over(Window.partitionBy("node")) / 2)
        x = x.select((F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node"), "i", "j")
        shards //= 2
    return x.groupBy("node", "i").agg(F.count("*").alias("blocks"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, shards: int = 8, seed: int = 17, keep: tuple[str, ...] = (), row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, draws.

    docs: doc_id, text, source; other columns are ignored. size: words; taken: words that the mix takes, repeats
    counted, between 0 and most * size; draws: (pass, shard, order, words) for every time the document is drawn,
    `order` being its place inside the shard. The last document of a source is taken in part, so that each
    source gives its rounded target exactly. A null source is a source of its own,
    repeated rows are separate documents, and empty texts are drawn with no words. The same input and
    seed give the same mix. An empty table gives an empty result. Per-source tables are small: a row for each
    source, and 16 ** DIGITS blocks of each. keep: columns of docs that go along. row: a column that numbers the rows of docs, the same
    whenever it is read; without one they are numbered here. Rows without doc_id and rows that share one are dealt by
    their number, so that none of them is a cell of its own size.
    """
    at = row or free_name(docs)
    if row is None:
        docs = numbered(docs, at, ["doc_id", "text", "source", *keep])
    go = list(dict.fromkeys([*keep, at]))
    sized = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), word_count("text").alias("size"), *go)
    sized = written(sized, "sizes")
    again = written(sized.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").withColumn("again", F.lit(True)), "again")
    shared = F.col("doc_id").isNull()
    if not again.isEmpty():
        sized = lookup(sized, again, ["doc_id"], sized.count(), F.col(at))
        shared = shared | F.col("again").isNotNull()
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(shared, F.concat(F.lit(":"), F.col(at).cast("string"))).otherwise(F.lit("")))
    sized = sized.select("doc_id", "source", "skey", "size", F.md5(key).alias("h"), *go)
    sources = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # running sums are made in ranges of the permuted order that hold about RANGE_DOCS documents
    digits = F.greatest(F.lit(DIGITS), F.ceil(F.log(16.0, F.greatest(F.col("docs") / RANGE_DOCS, F.lit(1.0))))).cast("int")
    size_of = sources.select("skey", digits.alias("digits"))
    plan = targets(sources.select("skey", "source", "source_size"), weights, share, most)
    plan = written(
        plan.join(size_of, "skey").select(
            "*",
            F.coalesce(F.expr("quota div nullif(source_size, 0)"), F.lit(0)).alias("full"),
            F.expr("quota - coalesce(quota div nullif(source_size, 0), 0) * source_size").alias("rest"),
        ),
        "plan",
    )
    dealt = sized.join(plan.select("skey", "digits"), "skey").withColumn("cell", F.expr("substr(h, 1, digits)"))
    cells = dealt.groupBy("skey", "cell").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("skey").orderBy("cell")
    cells = cells.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    cells = written(cells.join(plan, "skey"), "cells")

    # blocks that each pass draws: all in a whole pass, those before the rest is full in the last one
    drawn = cells.select("skey", "i", "full", F.substring("cell", 1, DIGITS).alias("block"), F.expr("sequence(0, cast(full as int) - IF(before < rest, 0, 1))").alias("passes"), "before", "rest")
    drawn = drawn.where("full > 0 or before < rest").select("skey", "i", "block", F.explode("passes").alias("pass")).distinct()
    permuted = Window.partitionBy("skey").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "skey", "pass", "block")))
    drawn = written(drawn.withColumn("place", F.row_number().over(permuted)), "drawn")
    counts = plan.select("skey", "i").join(drawn.groupBy("skey").agg(F.count("*").alias("blocks")), "skey", "left").select("i", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    leaf = splitting_tree(counts, shards, seed)
    upto = F.sum("blocks").over(Window.partitionBy("i").orderBy("node"))
    leaf = leaf.select("i", (F.col("node") - shards).alias("shard"), (upto - F.col("blocks")).alias("low"), upto.alias("high"))
    home = drawn.join(leaf, "i").where("place > low and place <= high").groupBy("skey", "block").agg(F.map_from_entries(F.collect_list(F.struct("pass", "shard"))).alias("home"))
    cells = cells.withColumn("block", F.substring("cell", 1, DIGITS)).join(home, ["skey", "block"], "left")

    x = dealt.join(cells.select("skey", "cell", "source_size", "target", "full", "rest", "before", "home"), ["skey", "cell"])
    run = Window.partitionBy("skey", "cell").orderBy("h", "doc_id", "size", at).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("upto", F.col("before") + F.sum("size").over(run))
    x = x.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size"))))
    # a pass in which some shard draws the document's block gives all of it, the last pass what the target still needs
    draws = """transform(filter(sort_array(map_keys(coalesce(home, map()))), p -> p < full OR extra > 0),
        p -> struct(p as pass, home[p] as shard, md5(concat(h, ':', p)) as order, IF(p < full, size, extra) as words))"""
    x = x.select("doc_id", "source", "size", "source_size", "target", F.expr(draws).alias("draws"), *go)
    taken = F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)").alias("taken")
    return x.select("doc_id", "source", "size", "source_size", "target", taken, "draws", *keep)
