"""Cycles of directed graphs: strongly connected components by trimming, colouring and reaching back.

Nothing of the graph is collected, and no table of pairs is made: all tables have a row for a node or an edge. Each round trims
nodes that nothing leads to or from; gives every node that is left the smallest node that reaches it (its colour); and takes from
each colour the nodes that reach its own root, which are one component. Those go, and so do edges between colours, since no cycle
crosses them. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.relational import settled_rows


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have an edge in and an edge out, until that holds for all."""
    n = edges.count()
    while n:
        inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        edges = settled_rows(inner.select("a", "b"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node from which each node can be reached, itself included.

    Only nodes whose colour has just changed send it on.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    colours = settled_rows(nodes.withColumn("colour", F.col("node")).withColumn("fresh", F.lit(True)))
    while True:
        sent = colours.where("fresh").select(F.col("node").alias("a"), "colour").join(edges, "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("got"))
        better = F.coalesce(F.col("got") < F.col("colour"), F.lit(False))
        colours = settled_rows(colours.join(sent, "node", "left").select("node", F.when(better, F.col("got")).otherwise(F.col("colour")).alias("colour"), better.alias("fresh")))
        if colours.where("fresh").isEmpty():
            return colours.select("node", "colour")


def reaching(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the nodes from which one of ``roots`` (node) can be reached along edges, roots included."""
    known = newest = settled_rows(roots.select("node").distinct())
    while not newest.isEmpty():
        back = newest.select(F.col("node").alias("b")).join(edges, "b").select(F.col("a").alias("node")).distinct()
        newest = settled_rows(back.join(known, "node", "left_anti"))
        known = known.unionByName(newest)
    return settled_rows(known)


def cycles(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, component, size) for every node that lies on a cycle; a component is named by its smallest node.

    An edge from a node to itself is a cycle of one; edges with a null end and repeated edges are left out; an empty table has
    no cycles.
    """
    pairs = settled_rows(edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    edges = trimmed(settled_rows(pairs.where("a <> b")))
    parts = []
    while not edges.isEmpty():
        colours = coloured(edges)
        a, b = colours.select(F.col("node").alias("a"), F.col("colour").alias("ca")), colours.select(F.col("node").alias("b"), F.col("colour").alias("cb"))
        within = settled_rows(edges.join(a, "a").join(b, "b").where("ca = cb").select("a", "b"))
        roots = colours.where("node = colour").select("node")
        # edges lead within one colour, so what reaches a root reaches that of its own colour
        done = reaching(within, roots).join(colours, "node").select("node", F.col("colour").alias("component"))
        sized = done.join(done.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").where("size > 1")
        parts.append(settled_rows(sized.select("node", "component", "size")))
        gone = done.select("node")
        left = within.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        edges = trimmed(settled_rows(left.select("a", "b")))
    out = loops.withColumn("component", F.col("node")).withColumn("size", F.lit(1).cast("long"))
    for part in parts:
        out = out.join(part.select("node"), "node", "left_anti").unionByName(part)
    return out
