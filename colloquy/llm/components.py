"""Connected components by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node of an edge (a, b), a <> b: comp is the smallest node that can be reached.

    Minima combine before the shuffle, so a node with a third of all edges is a few
    rows a task there; the joins with them are left to adaptive skew handling. The rounds grow with the logarithm of the
    longest path; each is written once.
    """
    seen = None
    edges = scratch.table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        before, edges = edges, scratch.table(_small(_large(edges)), "stars")
        scratch.drop(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        seen = now
