"""Connected components of large graphs by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored


def _star(edges: DataFrame) -> DataFrame:
    """Each row's b moves to the least node of a's neighbourhood. The least is stored apart, so that the join's sides
    are both dealt anew and a hot node's rows can be split."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    return edges.join(least, "a")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    hung = _star(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    return hung.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(hung.select("a", F.col("m").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other, on which nothing else than the star's nodes hangs."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge. Loops and repeated edges are allowed.

    The number of rounds grows with the logarithm of the longest path; the driver learns only whether all is done."""
    edges = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b"))
    while True:
        edges = stored(_small(stored(_large(edges))).where("a != b").distinct())
        if _are_stars(edges):
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
