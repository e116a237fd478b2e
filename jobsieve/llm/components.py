"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and `component` (the smallest node reachable) of every node that has a link.

    Alternating large-star and small-star rounds: every node's links are turned to the smallest neighbour until
    nothing changes; the rounds grow with the logarithm of the longest path. Neighbours are never gathered:
    each round takes a minimum by node (combined before the shuffle), keeps it as a table and joins that back, so
    that the join has shuffles of its own, in which Spark can split a hot node. Rounds are tables in the shared folder. Only a count and a checksum reach the driver.
    """
    x, y = F.col(a), F.col(b)
    edges = saved(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        # Large star: neighbours above a node link to the smallest of its neighbourhood.
        large = (both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = saved(large, "edges")
        # Small star: a node and its smaller neighbours link to the smallest of them.
        lowest = saved(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = (large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = saved(small, "edges")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    # Every edge is now (node, smallest node of its component).
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
