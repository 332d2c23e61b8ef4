"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node reachable, for every node of an edge.

    Each round takes the smallest label of the neighbours and then the label's own label, so chains halve; the number of
    rounds grows with the logarithm of the longest chain.  Nothing but a count reaches the driver."""
    both = materialise(edges.select("a", "b").where("a <> b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("over"))
        was = labels
        step = materialise(lower.join(jump, "to", "left").select("node", F.least(F.col("to"), F.coalesce("over", "to")).alias("component"), "was"), "labels")
        drop(was)
        labels = step
        if step.where("component <> was").isEmpty():
            drop(both)
            return step
