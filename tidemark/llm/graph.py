"""Connected components of an edge list, by rounds of contraction that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is its least node.

    A round maps each node to its least smaller neighbour and on to that one's, and keeps
    the distinct edges between different images. The image of a connected graph is
    connected and its least node maps to itself, so when no edge is left each node has
    come to the least of its component. Edges shrink with every round; rounds are staged,
    so none is lost with an executor. Repeated edges and loops change nothing; no edges
    give no rows.
    """
    edges = staged(edges.select("a", "b"), "links")  # read twice below
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = staged(nodes.withColumn("component", F.col("node")), "labels")
    live = _between(edges, "a", "b")
    while not live.isEmpty():
        # Staged, so that the join of a hub that many nodes share reads plain shuffles, which Spark splits.
        least = staged(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("least")), "least")
        above = least.select(F.col("node").alias("least"), F.col("least").alias("further"))
        image = staged(least.join(above, "least", "left").select("node", F.coalesce("further", "least").alias("image")), "images")
        moved = labels.join(image.withColumnRenamed("node", "component"), "component", "left")
        labels = staged(moved.select("node", F.coalesce("image", "component").alias("component")), "labels")
        ends = live.join(image.select(F.col("node").alias("a"), F.col("image").alias("x")), "a", "left").join(image.select(F.col("node").alias("b"), F.col("image").alias("y")), "b")
        live = _between(ends, F.coalesce("x", "a"), "y")
    return labels


def _between(edges: DataFrame, a, b) -> DataFrame:
    """Distinct edges of different ends, the lesser one first."""
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return staged(ends.where("a <> b").distinct(), "edges")
