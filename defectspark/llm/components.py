"""Connected components by smallest label with shortcuts, each round cut off by a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectspark.llm.common import store


def components(edges: DataFrame, name: str) -> DataFrame:
    """(``node``, ``label``) for every node of ``edges`` (``a``, ``b``); the label is the component's smallest node.

    A round takes the smallest label of the neighbours and then the label's own label, so the
    rounds grow with the logarithm of a path's length. Nothing but one count per round is collected.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = store(both, f"{name}-edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), f"{name}-labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        step = store(step.join(jump, "label").select("node", "old", F.least("label", "jump").alias("label")), f"{name}-labels")
        changed = step.agg(F.sum((F.col("old") != F.col("label")).cast("long"))).first()[0]
        labels = step.select("node", "label")
        if not changed:
            return labels
