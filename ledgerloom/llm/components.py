"""Connected components of an edge table by alternating large and small stars, one shuffle-joined round after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm._store import materialize, remove


def star(both: DataFrame) -> DataFrame:
    """u, v with m, the smallest of u and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge.

    edges: columns a, b. Self-loops don't matter; an empty table gives an empty result. The stars of a node with very many neighbours are
    partial minima and a join that Spark can split.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", lean=True)
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u != v").distinct(), "edges", lean=True)
        remove(now)
        now, was = after, before
        before = mark(now)
        if before == was:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
