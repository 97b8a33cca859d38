"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscreen.llm.common import cut, discard, join_aggregate


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``a``, ``b``, no nulls); the label is the smallest node reachable.

    Each round re-links neighbours to the smallest node they see, first the larger and then the smaller ones, until every node hangs
    directly under its label, which takes a number of rounds logarithmic in the longest chain. Neighbours are never gathered:
    each step is a ``min`` with map-side combine and a join whose hot nodes AQE can split, as the minima are shuffled anew. Every round is cut to
    a table and the one before is deleted.
    """
    edge = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edge.union(edge.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_aggregate(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = join_aggregate(large, least, ["a"])
        near = tied.select("a", F.col("m").alias("b")).union(tied.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        old, edge = edge, cut(near)
        discard(old)
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    up = edge.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return up.union(edge.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
