"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, lookup, materialize


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node's larger neighbours are joined with the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("degree"))
    return lookup(both.filter("b > a"), least, "a", "degree", 2 * rows).select(F.col("low").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node's smaller neighbours and the node itself are joined with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree"))
    moved = lookup(down, least, "a", "degree", rows).select(F.col("low").alias("a"), "b")
    return moved.union(least.select(F.col("low").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): the smallest node of its component.

    A round never makes more edges than it has, and rounds go on to the fixed point. Each writes its edges to the work
    folder, so lineage stays short and a lost executor costs one round, and deletes those of the round before.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).filter("a <> b").select("a", "b").distinct(), "components")
    marks = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    before, after = None, edges.agg(*marks).first()
    while before != after:
        grown = materialize(_large_star(edges, after[0]), "components")
        forget(edges)
        edges = materialize(_small_star(grown, grown.count()), "components")
        forget(grown)
        before, after = after, edges.agg(*marks).first()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
