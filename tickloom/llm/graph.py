"""Connected components by label passing with pointer jumping, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HOT, lookup
from .store import shuffled, written


def components(nodes: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """The smallest id that links reach from each node: (id, comp).

    nodes: (id, comp), where comp is a label that is known to belong to the same component, id itself
    at first. links: (a, b), either way round; nulls and self links count for nothing. Ids that links
    name must be nodes. Each round takes the least label of the neighbours, then the label of that
    label; stars end after one round, chains after a number that grows with the logarithm of their length.
    Where a hub or a large component holds a large share of the rows, its label is broadcast, fewer than skew.HOT of
    each, so that none makes a task that gets this share. rounds: stop after so many, with labels that hold but may not be the least yet.
    """
    one = links.where("a <> b").select("a", "b")
    both = written(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    label = nodes.select("id", "comp")
    degree = both.groupBy("b").agg(F.count("*").alias("c"))
    n_links, hub = degree.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    while n_links and (rounds is None or rounds > 0):
        rounds = None if rounds is None else rounds - 1
        if hub * HOT > n_links:
            ends = label.withColumnRenamed("id", "b").join(shuffled(degree), "b")
            ends = lookup(both, ends, ["b"], n_links, F.xxhash64("a"))
        else:
            ends = both.join(shuffled(label.withColumnRenamed("id", "b")), "b")
        near = ends.groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "id")
        known = written(label.join(shuffled(near), "id", "left"), "known")
        # what a label's own nodes have learnt goes to all that carry the label
        groups = known.groupBy("comp").agg(F.count("*").alias("c"), F.min("near").alias("heard"))
        n, news, most = groups.agg(F.sum("c"), F.count_if(F.expr("heard < comp")), F.max(F.expr("CASE WHEN heard < comp THEN c END"))).first()
        if not news:
            break
        groups = groups.where("heard < comp")
        step = lookup(known, groups, ["comp"], n, F.xxhash64("id")) if most * HOT > n else known.join(shuffled(groups.drop("c")), "comp", "left")
        label = written(step.select("id", F.least("comp", "heard", "near").alias("comp")), "labels")
    return label
