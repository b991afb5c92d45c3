"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vaultline.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of ``links`` (a, b).

    Each round a node takes the least label among its neighbours' and then that label's own label, so
    labels cross long chains in few rounds. Every round is written to the shared folder; only the number
    of changed labels comes to the driver, with the write itself. A node with very many links is no hot task: labels are
    aggregated before they are shuffled.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = least.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        changed = Observation()
        labels = written(step.observe(changed, F.count_if(F.col("old") != F.col("label")).alias("n")), "labels").select("node", "label")
        if not changed.get["n"]:
            return labels
