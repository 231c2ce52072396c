"""Connected components of a graph of links, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, merged_with, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(merged_with(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(merged_with(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Vertices of ``links`` (columns a, b: long) with their component's least vertex: columns v, label.

    Vertices that are their own label are left out. Each round ends in a written table, so lineage stays short; the
    number of rounds grows with the logarithm of a component's size. Self-links and repeated links are harmless.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Done when every vertex hangs on exactly one root: none has two parents, none is both child and parent.
        roles = edges.select(F.col("a").alias("v"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        odd = roles.groupBy("v").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or child > 0 and parent > 0")
        if odd.isEmpty():
            return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
        after = written(_small_star(_large_star(edges)), "links")
        forget(edges)
        edges = after
