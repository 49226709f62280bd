"""Connected components of large graphs of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_once


def _state(edges: DataFrame) -> tuple:
    """Number of edges and sums of two hashes of them: equal only for equal sets of edges, but for a chance of 2**-100."""
    h = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), h(1), h(2)).first())


def components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(``node``, ``root``) for every node of ``links``; ``root`` is the least node of its component.

    Alternating large-star and small-star rounds: each node's neighbours are tied to the least of them, so that trees
    turn into stars in a number of rounds that grows with the logarithm of the longest path. Nothing but counts and sums
    of hashes reaches the driver. A hot node has one row per neighbour: its least neighbour is summed up before rows are
    shuffled, and comes back to them by broadcast.
    """
    edges = cut(links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while True:
        # Large star: neighbours above a node are tied to the least node near it.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = cut(join_once(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: a node and its neighbours below are tied to the least of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_once(large, low, "u", "n")
        edges = cut(joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
