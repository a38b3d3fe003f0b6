"""Connected components by contraction: nodes point to their smallest neighbour, edges move to what their ends point to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of each node of edges (a, b). Edges may repeat, point to themselves or be none.

    Each round shrinks every component by at least half of its nodes; a star of any size goes in one round. What is written per
    round is bounded by the edges; nothing of it reaches the driver. A node with very many edges is summed before the shuffle.
    """
    edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        step = written(both.groupBy("node").agg(F.least("node", F.min("near")).alias("up")), "steps")
        steps.append(step)
        moved = edges.join(step.withColumnsRenamed({"node": "a", "up": "ua"}), "a").join(step.withColumnsRenamed({"node": "b", "up": "ub"}), "b")
        moved = moved.where("ua != ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        edges = written(moved.distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps.pop()
    while steps:
        step = steps.pop()
        later = out.select(F.col("node").alias("up"), F.col("up").alias("root"))
        out = written(step.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("up")), "steps")
    return out.withColumnRenamed("up", "root")
