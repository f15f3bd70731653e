"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orecart.llm.common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of (a, b) edges; root is the smallest node of the component.

    Each round takes the least label among a node and its neighbours (aggregated before the shuffle)
    and then the label of that label. Tables are written between rounds; only two counters reach the
    driver. Self loops and repeated edges are harmless; an empty edge table gives an empty result.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root")
    labels = stash(labels)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        hop = labels.select(F.col("node").alias("mid"), F.col("root").alias("hop"))
        moved = stash(low.join(hop, low["low"] == hop["mid"]).select("node", F.col("root").alias("was"), F.least("low", "hop").alias("root")))
        changed = moved.agg(F.count_if(F.col("was") != F.col("root"))).first()[0]
        labels = moved.select("node", "root")
        if not changed:
            return labels
