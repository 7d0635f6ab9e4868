"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b: long); the label is the smallest node that it reaches.

    Every round takes the least label among the neighbours and then the label's own label, so the number of rounds grows
    with the logarithm of the longest path. Labels are written after each round; no link or label comes to the driver.
    Empty links give an empty table; loops and repeated links change nothing.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        new = settle(low.join(jump, "low").select("node", "was", F.least("low", "next").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("was != label").isEmpty():
            return labels
