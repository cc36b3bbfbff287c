"""Connected components on Spark: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import cut


def _mins(edges: DataFrame) -> DataFrame:
    """Least neighbour of each node, as a table: a join with it shuffles both sides plainly, so AQE may split a hub."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _mins(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    edges = cut(edges)
    mins = _mins(edges)
    moved = edges.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(mins.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the least node that can be reached.

    Nodes are of any orderable type.  Loops, repeated edges and nulls are
    ignored; a node without edges is not in the result.  No node's edges meet in
    one task: minima are combined map-side and joins may be split by AQE.  Each
    round is written to the shared checkpoint folder.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = cut(start), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if not state[0] or state == seen:
            break
        seen = state
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
