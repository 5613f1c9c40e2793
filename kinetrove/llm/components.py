"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, loose, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component is the least node reachable.

    Both steps replace the links of a node by links to the least of its
    neighbourhood; a hub's links shrink to one each. Every round is written to
    the shared folder and only its change count reaches the driver.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(loose(least, "a"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        large = large.unionByName(own).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(loose(low, "a"), "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = stored(small.distinct(), "links")
        # settled once every node has one link and no node is both a root and a leaf
        unsettled = after.groupBy("a").count().where("count > 1").select("a").unionByName(after.select("a").join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        done = unsettled.limit(1).count() == 0
        discard(edges)
        edges = after
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
