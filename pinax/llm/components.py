"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: each node of ``edges (a, b)`` that is not the smallest of
    its component, with the smallest.

    Alternates large-star and small-star steps: in the first, every node hands
    its larger neighbours to the smallest node it knows; in the second, its
    smaller ones.  Both are aggregates and equi-joins, no node's neighbours are
    collected, and the number of rounds grows with the logarithm of the input.
    Each round is a staged table, so a lost executor costs a part of one round.
    """
    star = staged(edges.filter(F.col("a") != F.col("b"))
                  .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(roots, "u").filter(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(roots.select("u", F.col("m").alias("v"))).distinct())
        star = staged(small, "edges")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
