"""Connected components by alternating large-star and small-star steps, each cut to a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _stars(e: DataFrame, ws: Workspace, n: int) -> bool:
    """Whether every node has one edge to a smaller node, which has none: then the edges are the result."""
    ends = e.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return not ws.few(odd, 2 * n).limit(1).count()


def components(edges: DataFrame, ws: Workspace, rows: int | None = None) -> DataFrame:
    """``edges`` (a long, b long) to (node, component), the smallest node reachable; nodes without an edge get no row.

    Each step replaces the edges of a node by edges to its smallest neighbour, so the graph turns into stars after a
    number of steps that grows with the logarithm of the longest path. Minima are combined before the shuffle and
    written as tables, so that joins with a hot node are plain joins, which the adaptive planner splits.
    No step makes more edges than it gets, so the first table's size says how many tasks each is worth; ``rows`` is about
    the number of ``edges``, where that is known.
    Loops and repeated edges are allowed; rows with a null end are ignored; an empty table gives an empty one.
    """
    e = ws.cut(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
        rows,
    )
    n = e.count()  # from the files' footers
    while not _stars(e, ws, n):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ws.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", 2 * n)
        large = ws.cut(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large", n)
        low = ws.cut(large.groupBy("a").agg(F.min("b").alias("m")), "low", n)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = ws.cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges", n)
        ws.drop(e, least, large, low)
        e = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
