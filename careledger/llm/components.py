"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.storage import discard, materialize


def _print(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges; equal in two rounds once nothing moves any more."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (columns a, b of one orderable type) with the smallest node of its component.

    Only minima per node are aggregated, so a node of very many neighbours is never gathered; minima are written before they
    are joined, so that both sides of the join are plain shuffles, of which Spark splits a large one. The rounds grow with the
    logarithm of a component's size. Loops and repeated edges don't matter; rows with a null node are left out; an empty table gives no rows.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _print(now)
    while before[0]:
        # Large star: each larger neighbour of u moves to the smallest node that u knows.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low")
        large = materialize(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        # Small star: u and its smaller neighbours move to the smallest of these.
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-small")
        discard(now, low, large, least)
        now, found = after, _print(after)
        if found == before:
            break
        before = found
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
