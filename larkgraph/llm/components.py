"""Connected components of an edge table by repeated minima, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 200) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node it can reach.

    A round gives every node the least label among its neighbours and then that label's own label, so that
    chains shrink by half or more; stars, the usual shape, end in two rounds. Nulls and loops are left out.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = scratch.write(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = scratch.write(labels, f"{name}-0")
    for k in range(1, most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("up"))
        step = step.join(up, "via", "left").select("node", "old", F.least("via", F.coalesce("up", "via")).alias("label"))
        step = scratch.write(step, f"{name}-{k}")
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if k > 1:
            scratch.remove(f"{name}-{k - 2}") if k > 2 else None
        if not changed:
            return labels
    raise RuntimeError(f"components: labels still change after {most_rounds} rounds")
