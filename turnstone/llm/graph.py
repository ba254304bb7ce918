"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), in any direction, loops allowed -> (node, root), root the smallest node
    reachable, for every node but roots. Every round is a written table; one count and two sums of
    128 bits of hashes come to the driver, and equal ones end the rounds. Rounds grow with the
    logarithm of the longest chain.
    """
    now = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        then, now = now, stage(_small_star(_large_star(now)), "stars")
        unstage(then)
        hashes = (F.xxhash64("a", "b"), F.xxhash64(F.lit(1), "b", "a"))
        mark = now.agg(F.count("*"), *[F.sum(h.cast("decimal(20,0)")) for h in hashes]).first()
        if not mark[0] or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
