"""Connected components by alternating star contractions, without any row of the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b): long ids. Returns (node, root) for each node that has an edge; root is the smallest id reachable.

    Each round points larger neighbours at the smallest neighbour, then smaller ones at the smallest of those
    (large and small stars), until nothing changes: a number of rounds that grows with the logarithm of the longest path.
    Self-loops, repeats and nulls are ignored; no edges give no rows. Each round is written to the shared folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stage(pairs, "edges")
    sums = _sums(pairs)
    if sums[0] == 0:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stage(large.distinct(), "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", "m"))
        before, pairs = pairs, stage(small.distinct(), "stars")
        discard(before, large)
        was, sums = sums, _sums(pairs)
        if was == sums and pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(pairs.select("b", "b").distinct())


def _sums(pairs: DataFrame) -> tuple:
    """Count and a digest: equal digests of two rounds mean that nothing changed."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
