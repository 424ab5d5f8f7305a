"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the undirected ``edges (a, b)``; the component is its smallest node.

    Each round takes the smallest label among neighbours and then jumps to that label's own label, until nothing changes. State
    is checkpointed each round; hot nodes are only the many-rows side of joins and grouped minima, which combine map-side.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = cut_lineage(edges.where("a <> b").select(ends).select("e.a", "e.b").distinct())
    state = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"), F.lit(True).alias("moved"))
    state = cut_lineage(state)
    while not state.where("moved").isEmpty():
        labels = state.select(F.col("node").alias("b"), F.col("label").alias("near"))
        nearest = both.join(labels, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        hooked = state.select("node", F.col("label").alias("old")).join(nearest, "node").select("node", "old", F.least("old", "near").alias("label"))
        roots = state.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = hooked.join(roots, "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "old")
        state = cut_lineage(jumped.select("node", "label", (F.col("label") != F.col("old")).alias("moved")))
    return state.select("node", F.col("label").alias("component"))
