"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.session import cut


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component as label; links: (x, y).

    Each round takes the smallest label among the neighbours and then the label's own
    label, so chains shrink by halves. Both tables stay distributed; a hub is combined before
    the shuffle on one side and split by adaptive execution on the other.
    """
    both = cut(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    state = cut(nodes.select("node", F.col("node").alias("label")).distinct())
    while True:
        lab = state.select(F.col("node").alias("y"), F.col("label").alias("ly"))
        low = both.join(lab, "y").groupBy(F.col("x").alias("node")).agg(F.min("ly").alias("m"))
        stepped = state.join(low, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        own = state.select(F.col("node").alias("label"), F.col("label").alias("up"))
        now = cut(stepped.join(own, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        if now.where("label <> was").isEmpty():
            return now.select("node", "label")
        state = now.select("node", "label")
