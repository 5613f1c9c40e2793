"""Connected components of links, clip by clip, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, stored


def components(links: DataFrame, by: list[str]) -> DataFrame:
    """(by..., node, component) of every node of ``links`` (by..., a, b: whole numbers); a component is its least node.

    A round hangs every neighbour of a node that is larger than it below the least of its neighbourhood, then every smaller one, and so
    keeps what is connected connected while paths halve. It ends when all links lead to least nodes. Rounds are stored; the driver gets one count of each.
    """
    keys = [*by, "a"]
    turned = lambda e: e.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
    edges = stored(links.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(turned(edges))
        least = both.groupBy(*keys).agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, keys).where("b > a").select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select(*by, "a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = large.join(large.groupBy(*keys).agg(F.min("b").alias("m")), keys)
        hung = small.select(*by, "a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(*by, F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = stored(hung, "links")
        discard(edges)
        edges = after
        # settled: a node hangs below one other, which hangs below none
        loose = edges.groupBy(*keys).count().where("count > 1").select(*keys).unionByName(edges.select(*keys).join(turned(edges).select(*keys), keys, "left_semi"))
        if loose.isEmpty():
            roots = edges.select(*by, F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(*by, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
