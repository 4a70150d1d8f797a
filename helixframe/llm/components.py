"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.store import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it sees."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _unfinished(edges: DataFrame) -> DataFrame:
    two = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return two.union(chained)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; a component is named by its smallest node.

    Each round writes its edges to the shared folder; edges lead from larger to smaller
    nodes. It ends when they are stars: no node has two smaller neighbours and no smaller
    neighbour has one itself. Loops and repeated edges are allowed; no edges give no rows.
    Joins are on one node id, so a node with very many neighbours is pre-aggregated and its
    rows can be split.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _unfinished(edges).isEmpty():
        old, edges = edges, written(_small_star(_large_star(edges)), "edges")
        dropped(old)
    roots = edges.select(F.col("b").alias("node")).distinct()
    parts = written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component"))), "parts")
    dropped(edges)
    return parts
