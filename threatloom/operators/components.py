"""Connected components of links, by rounds that hang every node on smaller ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.session import written


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it is linked with, over any number of links) of every node of links (a, b).

    Each round first hangs all larger neighbours of a node on its smallest neighbour or itself, then all smaller ones; the stars that
    are left when nothing changes any more are the components. Links are distinct pairs, so a hub is as large as its component.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        step = written(small, "links")
        if step.exceptAll(edges).isEmpty() and edges.exceptAll(step).isEmpty():
            break
        edges = step
    heads = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
