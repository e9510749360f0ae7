"""Connected components of an edge table, by contraction in joins; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlweave.llm.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: one comparable type); root is the smallest node of the component.

    Each round points every node at its smallest neighbour, follows pointers twice, and keeps the edges between different
    pointers. Stars vanish in one round and paths shrink by more than half; at most one row per node and per edge moves.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("up")), "up")
        for _ in range(2):
            over = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            up = up.join(over, "up", "left").select("a", F.coalesce("top", "up").alias("up"))
        up = staged(up, "up")
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("up").alias("root"))
        else:
            step = up.select(F.col("a").alias("root"), F.col("up").alias("top"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        labels = staged(labels, "labels")
        left = edges.join(up, "a").select(F.col("up").alias("p"), F.col("b").alias("a"))
        left = left.join(up, "a").select(F.least("p", "up").alias("a"), F.greatest("p", "up").alias("b"))
        edges = staged(left.where("a <> b").distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
