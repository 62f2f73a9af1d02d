"""Connected components by alternating large-star and small-star steps, in DataFrame operations only.

Each step joins on a node and takes minima with partial aggregation, so that a node with a third of all
edges is pre-aggregated by its minimum and its join can be split. Rounds grow with the logarithm of
the longest path. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges a file of a round.
EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v long) -> (node, component), for each node on an edge between two nodes; component is the smallest node reachable.

    Null ends, loops and repeated edges count for nothing. An empty table gives an empty result.
    """
    tidy = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(tidy)
    n = now.count()
    while n:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Nodes that are the smallest of their neighbours keep their edges to it.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A round has no more edges than the one before, so a small table is written as few files.
        now = cut(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct().coalesce(max(1, -(-n // EDGES))))
        n, done = now.count(), _is_stars(now)
        if done:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node that points to another points to one, to which nothing else is above."""
    ends = edges.groupBy("u").agg(F.count("*").alias("out")).select(F.col("u").alias("node"), "out")
    inner = edges.select(F.col("v").alias("node")).distinct().join(ends, "node", "left_semi")
    return not ends.where("out > 1").select("node").unionByName(inner).limit(1).count()
