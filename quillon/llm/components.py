"""Connected components by least labels, hooked roots and pointer jumping, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for edges (a, b) of longs.

    In a round a node takes the least label of its neighbours, lowers the label of the node that its
    own label names likewise, and jumps. Rounds go on until no label moves: chains of 2,000 nodes with
    shuffled ids take some 15, of 100,000 some 23. Each is written to the shared folder; labels are
    aggregated as minima, so a node with very many edges sends one row per task.
    """
    both = materialise(edges.union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        told = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        closer = materialise(labels.join(told, labels.node == F.col("n")).select("node", "label", F.least("label", "near").alias("low")), "closer")
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        hooks = closer.where("low < label").groupBy(F.col("label").alias("root")).agg(F.min("low").alias("hook"))
        least = F.least("low", "jump", "hook")  # a null hook is passed over
        after = closer.join(up, closer.low == F.col("at")).join(hooks, F.col("node") == F.col("root"), "left")
        after = materialise(after.select("node", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels
