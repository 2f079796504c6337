"""Connected components of a graph of any size, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import store


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the greater neighbours of each node to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return _distinct(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its lesser neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _distinct(moved.unionByName(least.select("a", F.col("least").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): rows (a, b) that give each node but the least of its component that least node.

    Null ends and loops are dropped; an empty table gives an empty one. Every
    round ends in a table in the shared folder; rounds go on until one changes
    nothing.
    """
    edges = store.written(_distinct(edges.where("a is not null and b is not null")), "edges")
    state = None
    while True:
        edges = store.written(_small_star(_large_star(edges)), "edges")
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            return edges
        state = found
