"""Connected components of a link table, staged in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage, unstage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """vertex, component (the least vertex of it). Least-label spreading with pointer jumping: the
    number of rounds grows with the logarithm of the longest path; nothing is collected."""
    one = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src <> dst")
    edges = stage(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = stage(edges.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "vertex"))
    held = labels
    while True:
        around = edges.join(labels, edges.dst == labels.vertex).groupBy("src").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels.vertex == around.src, "left").select("vertex", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("vertex").alias("label"), F.col("label").alias("above"))
        new = stage(lower.join(up, "label", "left").select("vertex", "old", F.least("label", "above").alias("label")))
        unstage(held)
        held, labels = new, new.select("vertex", "label")
        if new.filter("old <> label").isEmpty():
            unstage(edges)
            return labels.select("vertex", F.col("label").alias("component"))
