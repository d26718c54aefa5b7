"""Connected components of a graph of integer ids, by alternating large-star and small-star.

Large-star links every larger neighbour of a node to the smallest id around the node; small-star links a node and its
smaller neighbours to the smallest of them. Both keep the components, and alternating them ends with every node linked
to its component's smallest id. A node's neighbours are never gathered: the smallest comes from an aggregation with
partial sums and is joined back, for hubs by a broadcast of at most SHARES rows, so that no task gets a hub's
neighbours. Every round is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, skew_join


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) the rows (node, component_id) of all nodes but each component's smallest.

    Loops, nulls and repeated edges are ignored; no edges, no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not is_star(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")).select("u", F.least("u", "m").alias("m"), "many")
        large = skew_join(both.where("v > u"), least, ["u"], "many").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many"))
        small = skew_join(large, least, ["u"], "many")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, cut(small, "edges")
        for done in (before, large):
            drop(done)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))


def is_star(edges: DataFrame) -> bool:
    """Every node has at most one smaller neighbour, and that one has none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
