"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that
    it reaches.

    Every node takes the smallest label among itself and its neighbours, then
    the label of its label (pointer jumping), until nothing changes. A node with
    very many links is summed map-side in the one step, and is split by the
    skewed-join handling in the other; each round is cut by a written table.
    """
    links = links.select("a", "b").where("a <> b")
    both = materialize(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("low")), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        lower = materialize(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("component")), "labels")
        heads = lower.select(F.col("node").alias("component"), F.col("component").alias("head"))
        after = materialize(lower.join(heads, "component").select("node", "was", F.col("head").alias("component")), "labels")
        labels = after.select("node", "component")
        if not after.where("was <> component").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
