"""Exact medians of groups of any size, by histograms that narrow the range of the middle values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.session import written

#: A group with no more values than this is small: its values fit in a task, and Spark's own percentile takes them.
SMALL = 100_000
#: Buckets of a histogram, and large groups that may be sent to all tasks.
BUCKETS, SENT_GROUPS = 4096, 100_000


def medians(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """key and median (the mean of the two middle values) of each group's values that aren't null or NaN.

    Large groups are never gathered: of each, the histogram over the range in which its middle values lie is counted before the
    shuffle, the range shrinks to one bucket, and so on until it holds a single value.
    """
    values = rows.select(F.col(key).alias("key"), value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    sizes = written(values.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "group-sizes")
    large = sizes.where(F.col("n") > SMALL)
    n_large = large.count()
    if not n_large:
        return values.groupBy("key").agg(F.percentile("v", 0.5).alias("median")).withColumnRenamed("key", key)
    sent = F.broadcast if n_large <= SENT_GROUPS else (lambda df: df)
    same = F.col("key").eqNullSafe(F.col("__key"))
    keys = large.select(F.col("key").alias("__key"))
    out = [values.join(sent(keys), same, "left_anti").groupBy("key").agg(F.percentile("v", 0.5).alias("median"))]
    heavy = values.join(sent(keys), same, "left_semi")
    # The two middle ranks, from 0, and how many values lie below the range.
    state = large.select(F.col("key").alias("__key"), F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"))
    found = [state.where("low = high")]
    state = written(state.where("low < high"), "ranges")
    while not state.isEmpty():
        inside = heavy.join(sent(state), same & F.col("v").between(F.col("low"), F.col("high")))
        # The difference of two large values of different sign may be infinite; halves of small ones may vanish.
        wide = F.col("high") - F.col("low") == float("inf")
        share = F.when(wide, F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)).otherwise((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")))
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        counted = inside.groupBy("key", "rank", "below", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("key", "rank").orderBy("bucket")) + F.col("below")  # over BUCKETS rows
        hit = counted.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        step = written(hit.select(F.col("key").alias("__key"), "rank", "low", "high", (F.col("upto") - F.col("n")).alias("below")), "ranges")
        found.append(step.where("low = high"))
        state = step.where("low < high")
    middle = reduce(DataFrame.unionByName, found).groupBy(F.col("__key").alias("key")).agg((F.min("low") / 2 + F.max("low") / 2).alias("median"))
    return out[0].unionByName(middle).withColumnRenamed("key", key)
