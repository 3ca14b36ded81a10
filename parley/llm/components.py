"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import ensure_checkpoint_dir


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``links(a, b)``: the smallest node that is
    reachable from it.

    Each round takes the smallest label among the neighbours and then the label
    of that label (pointer jumping); rounds go on until no label changes, and
    each is checkpointed in the shared folder. Only the number of changed rows
    reaches the driver. A hub's rows are pre-aggregated by ``min``.
    """
    ensure_checkpoint_dir(links.sparkSession)
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))).checkpoint()
    labels = (both.groupBy("u").agg(F.min("v").alias("v"))
              .select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
    labels = labels.checkpoint()
    while True:
        near = (both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near")))
        step = (labels.join(near, labels["node"] == near["u"])
                .select("node", F.col("label").alias("old"), F.least("label", "near").alias("to")))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = (step.join(jump, step["to"] == jump["at"])
                 .select("node", F.least("to", "further").alias("label"), (F.least("to", "further") != F.col("old")).alias("moved"))
                 .checkpoint())
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels
