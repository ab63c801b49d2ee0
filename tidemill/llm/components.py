"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the component is its smallest node.

    Labels shrink by alternating two steps until none changes: each node takes the least label among
    its neighbours, then the label of its label. Both aggregate before they shuffle, and every round
    is written out, so that the lineage stays short. Loops and repeated edges are allowed; an empty
    frame gives an empty result.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = stepped.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("changed"))
        after = materialize(moved, "cc-labels")
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    return labels.select("node", F.col("label").alias("component"))
