"""Connected components of an edge table: alternating large-star and small-star rounds on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.exchange import stored


def _digest(pairs: DataFrame) -> tuple:
    """Order-free fingerprint of a table of distinct pairs; equal in two rounds once the stars are final."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(20,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is the smallest node it reaches.

    Large-star links every larger neighbour to the smallest one, small-star the smaller neighbours; both keep
    one row an edge and a minimum that combines before the shuffle, so a node of any degree is no hot group.
    The number of rounds grows with the logarithm of the longest path.  No edges give no rows.
    """
    pairs = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _digest(pairs)
    while before[0]:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u != v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = stored(after)
        now = _digest(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
