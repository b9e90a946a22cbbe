"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import saved

PLAIN_ROUNDS = 3


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node with a link ``(a, b)``; the label is the component's smallest node.

    Each round a node takes the smallest label among its own and its neighbours', and is written as a
    table. Components of a few links' width need nothing else; after ``PLAIN_ROUNDS`` rounds a node also
    takes the label of its label, so that long chains shrink by doubling.
    """
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = saved(links.select("a", "b").unionByName(turned).filter("a <> b").distinct(), "links-both")
    labels = both.groupBy(F.col("b").alias("node")).agg(F.least(F.min("a"), F.col("node")).alias("label"))
    rounds = 0
    while True:
        rounds += 1
        labels = saved(labels, "labels") if rounds == 1 else labels
        # a node's own label comes along, so that one grouping gives the next
        own = labels.select("node", F.col("label").alias("near"), F.col("label").alias("old"))
        told = both.join(labels.withColumnRenamed("node", "b"), "b").select(
            F.col("a").alias("node"), F.col("label").alias("near"), F.lit(None).cast("long").alias("old"))
        rows = own.unionByName(told).groupBy("node").agg(F.min("near").alias("label"), F.max("old").alias("old"))
        if rounds > PLAIN_ROUNDS:
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
            rows = rows.join(jump, "label", "left").select("node", F.least("label", F.coalesce("jump", "label")).alias("label"), "old")
        rows = saved(rows, "labels")
        labels = rows.select("node", "label")
        if rows.filter("label <> old").isEmpty():
            return labels
