"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: `edges` has long columns a and b; the root is the least node.

    Each round points the greater neighbours of a node to its least one, then the lesser ones; the edges left
    at the end are a star around each root. Rounds grow with the logarithm of the nodes. Only counts come to the
    driver; the edges are checkpointed each round. Edges that the first half of a round makes twice (one for each edge
    at most) go at its end, in one shuffle with the others.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
