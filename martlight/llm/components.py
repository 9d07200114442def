"""Connected components of a graph given as edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlight.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of ``edges`` (a, b) is linked with.

    Every round, (1) each node takes the smallest label among its own and its neighbours', and hands
    it to the node its own label names (the root), and (2) labels jump to their label's label. Chains
    shorten by more than half each round, so rounds grow with the logarithm of the longest path. Each
    round is written to the shared folder, which cuts the lineage. Minima are combined before the
    shuffle, so a node with very many edges is one row per task; joins on it can be split, as labels
    are unique. Nodes without edges do not appear; an empty input gives an empty result.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(edges.where("a <> b").select(F.inline(ways)).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        at = labels.withColumnRenamed("node", "b").withColumnRenamed("label", "other")
        offered = (
            both.join(at, "b").groupBy("a").agg(F.min("other").alias("other"))
            .join(labels.withColumnRenamed("node", "a"), "a")
            .select("a", F.least("other", "label").alias("new"), "label")
        )
        offered = written(offered, "offers")
        # The node itself and the root it named both learn of the smaller label.
        better = offered.select(F.col("a").alias("node"), "new").union(
            offered.where("new < label").select(F.col("label").alias("node"), "new")
        )
        hooked = better.groupBy("node").agg(F.min("new").alias("label"))
        parent = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(parent, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = written(jumped, "labels")
        if offered.where("new < label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
