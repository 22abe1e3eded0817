"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component for every node of ``edges`` (a long, b long).

    Each round every node takes the least label among its neighbours', then
    that label's own, so paths halve; labels are written after each round.
    Neighbours are pre-aggregated before the shuffle, so a node with very many
    is no large group.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("label").alias("top"))
        moved = written(step.join(up, "to", "left").select("node", F.least("to", F.coalesce("top", "to")).alias("label"), F.col("label").alias("old")), "labels")
        changed = moved.where("label <> old").limit(1).count()
        drop(labels)
        labels = moved.select("node", "label")
        if not changed:
            return labels
