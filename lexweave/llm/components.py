"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import written


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round takes the least label among a node and its neighbours, then the
    label of that label. Labels are summed up by partial minima and looked up by
    unique rows, so a node with very many neighbours is no single task. Every
    round's labels are a written table, so a lost executor loses no round.
    """
    both = edges.select("a", "b").where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        step = written(step, name)
        labels = step.select("node", "label")
        if not step.where("label <> old").take(1):
            return labels
