"""Connected components of an edge table, as joins and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limnoscope.llm.rows import released, settled


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (columns a, b).

    Every round takes the smallest label among a node and its neighbours, then the label's own label, so long chains
    halve. Labels are checkpointed each round and only a count comes back to the driver. Null ends are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = settled(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    after = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        before, labels = after, after.select("node", "component")
        near = both.join(labels.select(F.col("node").alias("b"), "component").hint("merge"), "b")
        low = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        hooked = labels.join(low.hint("merge"), "node", "left").select("node", "component", F.least("component", F.coalesce("low", "component")).alias("low"))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("far"))
        after = settled(
            hooked.join(jump.hint("merge"), "low", "left").select(
                "node", F.least("low", F.coalesce("far", "low")).alias("component"), F.col("component").alias("was")
            )
        )
        released(before)
        if after.where("component <> was").isEmpty():
            released(both)
            return after.select("node", "component")
