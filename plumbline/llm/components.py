"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import release, written


def digest(edges: DataFrame) -> tuple:
    """Count and hash sums of distinct edges: equal for equal sets of edges, in any order."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) edges; a component's name is its smallest node.

    Large-star and small-star steps alternate until no edge changes. Edges never gather in one task: a
    node's smallest neighbour is a partial aggregate, and goes back to its edges by a join that
    adaptive execution splits if the node is hot. Every round is written to the shared folder.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    after = digest(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))).distinct()
        following = written(small, "edges")
        before, after = after, digest(following)
        edges = following
        release(edges.sparkSession)
        if before == after:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
