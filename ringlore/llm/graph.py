"""Connected components by propagation of the least label, with pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its least node.  Loops and null ends count for nothing."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = checkpointed(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = checkpointed(step.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("far", "next")).alias("next")))
        if step.where(F.col("next") != F.col("component")).limit(1).count() == 0:
            return labels
        labels = step.select("node", F.col("next").alias("component"))
