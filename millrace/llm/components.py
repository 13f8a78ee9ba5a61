"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node on an edge; root is the least node it is connected with.

    Each round ties every node's larger neighbours to its least neighbour, then its smaller ones, until
    all edges end in roots; rounds grow with the logarithm of the longest path. Neighbours are
    never gathered: a round is an aggregate of minima and a join, so a node may have any number.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = materialise(pairs, "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node go to its least neighbour or itself.
        large = pairs.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large-star")
        # Small star: a node and its neighbours below it go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialise(small, "small-star")
        if new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and _one_parent(new):
            break
        pairs = new
    return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _one_parent(edges: DataFrame) -> bool:
    return edges.groupBy("u").count().where("count > 1").isEmpty()
