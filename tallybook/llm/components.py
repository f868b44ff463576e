"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.sources.staging import stage


def fewer_links(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components: every b keeps its least a, to which its other a are linked instead.

    Where many stars hold the same nodes, as the runs of a similarity join make them, the links between their centres
    coincide: what is left follows the nodes, not nodes times stars.
    """
    centred = links.filter("a != b").select("a", "b", F.min("a").over(Window.partitionBy("b")).alias("least"))
    kept = centred.select(F.col("least").alias("a"), "b").distinct()
    return kept.union(centred.filter("a != least").select("least", "a").distinct())


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b); the root is the smallest node of the component.

    Every round takes the least label among neighbours and then the label of that label, so that paths shorten
    by half or more; it ends when a round changes nothing. Rows of a hub are combined before they are shuffled.
    """
    both = stage(
        links.filter("a != b").select("a", "b").union(links.filter("a != b").select("b", "a")).distinct()
    )
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        heard = (
            both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("heard"))
        )
        nearer = stage(
            labels.join(heard, labels["node"] == heard["a"]).select(
                "node", F.least("root", "heard").alias("root"), F.col("root").alias("before")
            )
        )
        of_root = nearer.select(F.col("node").alias("via"), F.col("root").alias("far"))
        # a root is a node of the same component, so every row finds its root's label
        nearest = stage(
            nearer.join(of_root, nearer["root"] == of_root["via"]).select("node", F.least("root", "far").alias("root"), "before")
        )
        labels = nearest.select("node", "root")
        if nearest.filter("root != before").isEmpty():
            return labels
