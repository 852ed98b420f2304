"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long): the smallest node that it is linked with.

    Rounds of contraction: every component points at its smallest neighbour if that is smaller than itself, pointers
    are followed twice, links are relabelled and those within a component dropped. At least every second component
    that still has a link to another one disappears in a round. Each round is written to the shared folder. All rows are two
    numbers, and no aggregation follows a join, so a label that a large part of the nodes shares is split by the adaptive
    skew join; joining hot labels by broadcast cost the driver of op2_minhash more memory than it has (see README).
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "nodes")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("from"), F.least("a", "to").alias("to"))
        step = materialize(followed(followed(step)), "pointers")
        relabel = step.select(F.col("from").alias("component"), "to")
        nodes = materialize(nodes.join(relabel, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "nodes")
        a, b = step.select(F.col("from").alias("a"), F.col("to").alias("a2")), step.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(a, "a").join(b, "b").where("a2 <> b2")
        edges = materialize(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    return nodes


def followed(step: DataFrame) -> DataFrame:
    """Every pointer goes where the one it points at goes."""
    after = step.select(F.col("from").alias("to"), F.col("to").alias("next"))
    return step.join(after, "to").select("from", F.col("next").alias("to"))
