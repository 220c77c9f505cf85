"""Connected components of a table of links, in rounds of two local rules.

Every round links each node's larger neighbours, then each node's smaller ones, to the
smallest among them. Both rules are an aggregation and a join, so a node with very many
links is summed in parts and its join is split. Edges become stars around the smallest
node of each component in a logarithmic number of rounds. Each round is written to the
shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.texts import stored


def _linked_to_least(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a > b) after one rule. ``larger``: applied to the larger neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if larger else edges.select("a", "b")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # The node itself goes to the least of its smaller neighbours, as they do.
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node is linked to one other, and none of these has a smaller one."""
    centres = edges.select(F.col("b").alias("a"))
    once = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    # One job: nodes with several links, or that are a centre themselves.
    return once.join(centres.distinct().withColumn("centre", F.lit(1)), "a", "left").where("n > 1 or centre = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with a link. links: a, b."""
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while not _stars(edges):
        edges = stored(_linked_to_least(_linked_to_least(edges, True), False), "edges")
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(centres)
