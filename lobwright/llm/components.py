"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobwright.sources.stages import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Points the neighbours of each node at the smallest of them: the larger neighbours, or the smaller ones and itself."""
    sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        moved = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = sides.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): ``root`` is the smallest node that can be reached.

    Alternating large and small stars: each round at least halves long paths, and the edges never grow in number beyond
    nodes and edges together.  Every round is written, so a lost executor costs that round at most; only two numbers
    come to the driver.
    """
    current = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        current = cut(_stars(_stars(current, True), False), "edges")
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b").distinct())
        seen = state
    raise RuntimeError(f"components are still joining after {rounds} rounds")
