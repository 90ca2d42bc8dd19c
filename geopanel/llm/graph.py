"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.skew import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); label is the smallest node reachable.

    Every round takes the smallest label among the neighbours and then the
    label of that label, so stars settle in two rounds and long chains in few.
    Each round is written to the checkpoint folder; only a count of changed
    labels reaches the driver. Null ends and loops are ignored.
    """
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(links.union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        lower = lower.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label"))
        lower = materialize(lower, "labels")
        labels = lower.select("node", "label")
        if not lower.where("label <> old").limit(1).count():
            return labels
