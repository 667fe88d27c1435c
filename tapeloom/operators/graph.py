"""Connected components of small graphs of many keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the least node each one reaches over edges (a, b).

    A round takes the least label among neighbours and then the label's own label, so a chain of n
    nodes takes about log n rounds. Each round is written to the session's checkpoint folder.
    Joins ask for merging, as stored labels are small in the file but not in memory.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(nodes.select("node", F.col("node").alias("label")).distinct())
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        roots = step.select(F.col("node").alias("label"), F.col("label").alias("root")).hint("merge")
        moved = materialise(step.join(roots, "label", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label")))
        done = moved.filter("label <> was").isEmpty()
        labels = moved.select("node", "label")
        if done:
            return labels
