"""Connected components of an edge list by contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm.shared import saved


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (smallest node that edges a, b reach) for each node with an edge.

    Each round points every node to its smallest neighbour, follows that twice, and contracts the
    edges; at least half of the nodes that still have edges vanish. Rounds are written to the
    shared folder, nothing is collected. A hub's edges are summed by partial aggregation, and joins
    on it are left to Spark's splitting of skewed joins.
    """
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    mapping = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        parent = both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p").select("v", F.col("q").alias("p"))
        parent = saved(parent, name)
        if mapping is None:
            mapping = parent.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("v").alias("component"), "p")
            mapping = mapping.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        mapping = saved(mapping, name)
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(pa, "a").join(pb, "b").where("pa <> pb")
        edges = saved(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), name)
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping
