"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qagrade.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of the links `a`, `b`.

    Each round a node takes the least label of its neighbours, then the label of its label, so
    long chains shorten by halves. The labels of a round are a stored table; a round without a
    change is the last.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a <> b").distinct(), "links")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        new = stored(step, "labels")
        changed = new.where("label <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(edges)
            return labels.select("node", "label")
