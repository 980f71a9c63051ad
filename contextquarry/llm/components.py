"""Connected components of a distributed list of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import materialize


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges (a, b: long) -> (node, label): label is the least node of the component.

    A label is a node of the same component, never above its node. Each round a node takes the least of its label, the label of its label, and those labels of labels
    of its neighbours; what it found at its neighbours is also given to the node that is its label, so whole trees are
    hooked, not single nodes, and the number of rounds grows with the logarithm of a path's length. The loop ends when no label changes: then
    neighbours have equal labels, and these label themselves. More than `rounds` rounds are an error, as labels would be wrong. Nothing is collected; each round is a written table.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).where("x <> y").distinct()
    both = materialize(both, "cc-edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label")), "cc-labels")
    for _ in range(rounds):
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("_above"))
        known = materialize(labels.join(above, "label").select("node", "label", "_above"), "cc-above")
        near = both.join(known.select(F.col("node").alias("y"), "_above"), "y").groupBy(F.col("x").alias("node")).agg(F.min("_above").alias("_near"))
        least = materialize(known.join(near, "node"), "cc-near")
        hooks = least.groupBy(F.col("label").alias("_root")).agg(F.min("_near").alias("_hook"))
        new = least.join(hooks, F.col("node") == F.col("_root"), "left")
        # least() passes over nulls
        new = materialize(new.select("node", F.least("label", "_above", "_near", "_hook").alias("label"), F.col("label").alias("_old")), "cc-labels")
        labels = new.select("node", "label")
        if not new.where("label <> _old").take(1):
            return labels
    raise RuntimeError(f"labels of components still change after {rounds} rounds")
