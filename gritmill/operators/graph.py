"""Degrees, reciprocal edges, reachability, distances and strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import settled


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of all nodes, zero-filled; edges (src, dst) count once."""
    one = edges.select("src", "dst").distinct()
    ends = one.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(one.select("dst", F.lit(1), F.lit(0)))
    sums = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("node").distinct().join(sums, "node", "left").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def reciprocal(edges: DataFrame) -> DataFrame:
    """Pairs a < b with edges both ways: grouped by the unordered pair, no self join."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).cast("int").alias("up"))
    return pair.groupBy("a", "b").agg(F.min("up").alias("lo"), F.max("up").alias("hi")).where("lo = 0 and hi = 1").select("a", "b")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of all nodes within ``depth`` undirected steps of the seeds, with the least depth. A static plan of
    ``depth`` joins; only the frontier is joined with the edges."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(frontier)
    return seen


def impact(edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """(node, depth, via) of all nodes that depend on changed ones: edges (src, dst) say that src uses dst, so they are
    walked backwards. ``via`` is the smallest node of the level before through which a node is reached; depth 1 is direct,
    more is transitive. Changed nodes themselves are left out. Null ends count for nothing; loops and repeats are allowed."""
    uses = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    seen = frontier = changed.select("node").distinct().select("node", F.lit(0).alias("depth"), F.col("node").alias("via"))
    for d in range(1, depth + 1):
        step = uses.join(frontier.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("via"))
        frontier = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "via")
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def cycles_of_two_steps(edges: DataFrame) -> DataFrame:
    """The nodes of reciprocal edges, with how many such partners each has."""
    pairs = reciprocal(edges)
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("partners"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that touch one of the nodes: the one-step neighbourhood."""
    n = nodes.select("node").distinct()
    a = edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")
    b = edges.join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    return a.union(b).distinct()


def distances(edges: DataFrame, roots: DataFrame, first: int = 1) -> DataFrame:
    """(node, depth, via) of all nodes that the roots reach along src -> dst, without a bound on the depth: roots have depth
    ``first`` and no via; via is the smallest node of the level before. Null ends and null roots count for nothing, loops
    and repeats are allowed, no roots give no rows. One join of the frontier a level; lineage is cut every few levels."""
    uses = settled(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    start = roots.select("node").where("node is not null").distinct()
    seen = frontier = settled(start.select("node", F.lit(first).alias("depth"), F.lit(None).cast(start.schema["node"].dataType).alias("via")))
    depth = first
    while not frontier.isEmpty():
        depth += 1
        step = uses.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        frontier = settled(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "via"))
        seen = seen.union(frontier)
        if depth % 8 == 0:
            seen = settled(seen)
    return seen


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges whose ends have edges on both sides, until nothing changes: what is cut off lies on no cycle."""
    left = edges.count()
    while left:
        edges = settled(edges.join(edges.select(F.col("dst").alias("src")), "src", "left_semi").join(edges.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
        before, left = left, edges.count()
        if before == left:
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(node, c): the smallest node that reaches each node, itself included. Only nodes whose colour moved send it on."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colour = moved = settled(nodes.withColumn("c", F.col("node")))
    while not moved.isEmpty():
        sent = edges.join(moved.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
        both = settled(colour.join(sent, "node", "left").select("node", F.least("c", "m").alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("moved")))
        colour, moved = both.select("node", "c"), both.where("moved")
    return colour


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (src, dst): nodes that reach each other share the smallest of them.
    A node on no cycle is a component of its own; edges with a null end count for nothing.

    Colouring: nodes on no cycle are trimmed, the smallest reaching node colours each node forwards, and what reaches that
    node backwards within its colour is its component; found components leave, the rest is coloured again. Rounds follow
    the diameter, each is a join of the nodes that moved."""
    all_edges = settled(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    nodes = all_edges.select(F.col("src").alias("node")).union(all_edges.select("dst")).distinct()
    found = None
    left = _trimmed(all_edges.where("src <> dst"))
    while not left.isEmpty():
        colour = _colours(left)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
        same = settled(left.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("src", "dst"))
        seen = frontier = colour.where("node = c")
        while not frontier.isEmpty():
            step = same.join(frontier.select(F.col("node").alias("dst"), "c"), "dst").select(F.col("src").alias("node"), "c").distinct()
            frontier = settled(step.join(seen.select("node"), "node", "left_anti"))
            seen = settled(seen.union(frontier))
        found = seen if found is None else found.union(seen)
        gone = seen.select("node")
        left = _trimmed(settled(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def cycle_sizes(components: DataFrame) -> DataFrame:
    """(component, size) of the components with more than one node: their number is the number of cyclic groups."""
    return components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")


def graph_export(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges of a graph as two tables, each row once; edges with a null end are left out."""
    kept = edges.where("src is not null and dst is not null").distinct()
    return kept.select(F.col("src").alias("node")).union(kept.select("dst")).distinct(), kept


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes: the sub-graph that a filter leaves."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
