"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import reliable

#: Links in one task. A round's shuffles of a small table would else make as many tasks and files as there are shuffle partitions.
LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in links (a long, b long).

    Each round takes the least label among a node's neighbours, pre-aggregated in every task, then
    the label of that label, so chains shrink by halves. Rounds are checkpointed in the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    both = reliable(both)
    tasks = max(1, math.ceil(both.count() / LINKS))
    both = both.coalesce(tasks)
    labels = reliable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")).coalesce(tasks))
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), F.col("label").alias("near"), F.lit(None).cast("long").alias("before"))
        own = labels.select("node", F.col("label").alias("near"), F.col("label").alias("before"))
        lower = told.coalesce(tasks).unionByName(own).groupBy("node").agg(F.min("near").alias("near"), F.max("before").alias("before")).coalesce(tasks)
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = lower.join(jump, "near", "left").select("node", "before", F.least("near", F.coalesce("far", "near")).alias("label"))
        moved = reliable(moved.coalesce(tasks))
        labels = moved.select("node", "label")
        if moved.where(F.col("before") != F.col("label")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))
