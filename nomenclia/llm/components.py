"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenclia.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node of its component; staged.

    Every round takes the least label next to each node and then the label of
    that label, so that long paths shorten by half; rounds end when no label
    changes. Only a count reaches the driver.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = stage(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        # A node's label is a node of its component, so it has a label itself.
        jumped = hooked.join(hooked.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", "old", F.least("label", "next").alias("label"))
        new = stage(jumped, "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
