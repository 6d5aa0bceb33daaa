"""Connected components by alternating large and small stars, each round a written stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import drop, stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below move to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root: the smallest node that it reaches.

    Rounds go on until the edges are stars and stay the same; loops and repeated
    edges do no harm, and no group is gathered in one place: a hot node's edges are
    joined with its minimum.
    """
    edges = stage(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    mark = None
    while True:
        turned = stage(_small(_large(edges).where(F.col("a") != F.col("b")).distinct()).distinct(), "edges")
        drop(edges)
        edges = turned
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
