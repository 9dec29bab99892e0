"""Connected components of an edge table, as Spark joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root) for every node of an edge; ``root`` is the least node of its component.

    Every round a node takes the least label among its neighbours and itself,
    then the label of that label, so chains shorten by half or more.  Rounds
    are stored, which cuts the lineage, and end when no label changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("least"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "least").alias("next"))
        ends = labels.select(F.col("node").alias("end"), F.col("root").alias("end_root"))
        jumped = moved.join(ends, moved["next"] == ends["end"]).select("node", "was", F.least("next", "end_root").alias("root"))
        jumped = stored(jumped, "cc-labels")
        labels = jumped.select("node", "root")
        if jumped.where("was <> root").isEmpty():
            return labels
