"""Connected components of a graph that is itself distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (node, component), the component being its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round is two joins by key, and
    the rounds grow with the logarithm of the graph. Only sums of a table come to the driver. Each round
    is written to the shared folder. Nodes without an edge to another node don't appear; nulls, loops and repeated edges
    are dropped.
    """
    start = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = materialize(start, "edges"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return _labels(now)
        seen = state
        now = materialize(_small_star(_large_star(now)), "edges")
    raise RuntimeError("components did not settle")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.select(F.col("u").alias("c"), "m"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _labels(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.union(stars.select(F.col("u").alias("node"), F.col("v").alias("component")))
