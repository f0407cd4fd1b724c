"""Connected components of an edge table by min-label hooking and contraction; no step gathers a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.llm.store import save


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): every node of an edge, and one node of its component.

    Each round hooks every label to its smallest neighbour, jumps pointers, and contracts the edges to labels;
    edges inside a label vanish, so the tables shrink. Loops and repeated edges are allowed; nodes without any
    edge to another node do not appear. An empty table gives an empty table.
    """
    edges = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
            parent = parent.join(up, F.col("p") == F.col("_a")).select("a", F.col("_p").alias("p"))
        parent = save(parent, "parents")
        left, right = (parent.select(F.col("a").alias(x), F.col("p").alias(y)) for x, y in (("a", "pa"), ("b", "pb")))
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(parent, F.col("root") == F.col("a"), "left").select("node", F.coalesce("p", "root").alias("root"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = save(moved.where("a <> b").distinct(), "edges")
        labels = save(labels, "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
