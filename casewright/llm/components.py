"""Connected components of an undirected graph given as an edge table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators.common import reliable_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node that it reaches.

    Each round takes the smallest label of the neighbours and then the label of that
    label, so paths halve; a star ends after two rounds. Rows are two longs, every
    round ends in a reliable checkpoint, and adaptive execution splits a hot label.
    """
    both = reliable_checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = reliable_checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        of_label = better.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = reliable_checkpoint(better.join(of_label, "label").select("node", F.col("next").alias("label"), "old"))
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("old")).isEmpty():
            return labels
