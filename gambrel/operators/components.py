"""Connected components of an edge table, by least labels with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gambrel.shared import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, label): the least node that can be reached. Nodes without edges are not listed.

    Each round joins every node's greater neighbours, then its lesser ones, to the least of them (large-star and
    small-star), until each node has one edge, to the least; rounds grow with the logarithm of a component's size. Each
    round is written, which cuts lineage. Null ends are no edges.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialise(now, "component-edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        # a node without greater neighbours is itself joined to its least one
        large = large.union(least.where("least < u").select("u", F.col("least").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u")
        small = small.where("v > least").select("v", "least").union(small.select("u", "least"))
        now = materialise(small.toDF("u", "v").distinct(), "component-edges")
