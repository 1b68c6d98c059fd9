"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's (large: greater, else: smaller) neighbours and, for small stars, the node itself point to the least around it."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, work: Tables, name: str) -> DataFrame:
    """u, v: every node with an edge that is not the least of its component, and that least node; a table of `work`.

    edges: u, v (long). Each turn makes stars around greater, then around smaller nodes; it ends when a turn changes
    nothing, after a number of turns that grows with the logarithm of the longest path.
    """
    turn, before = 0, None
    edges = work.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges
        before, turn = mark, turn + 1
        edges = work.write(_stars(_stars(edges, True), False), f"{name}-{turn}")
        work.discard(f"{name}-{turn - 1}")
