"""Dashboard aggregations over articles, checks and executions; each is one pre-aggregated grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.operators.reports import exact_mean


# Buckets of scores, from and to, in the order in which they are tried.
SCORE_BUCKETS = ((0.1, 10, "1-10"), (10.1, 25, "11-25"), (25.1, 50, "26-50"), (50.1, 75, "51-75"), (75.1, 90, "76-90"), (90.1, 99, "91-99"), (99.1, 100, "99-100"))


def score_histogram(articles: DataFrame, score: Column) -> DataFrame:
    """Articles by bucket of their score (fixed values); scores between two buckets, which tenths can't be, are Unknown."""
    bucket = F.when(score.isNull(), "Null").when(score == 0, "0")
    for low, high, name in SCORE_BUCKETS:
        bucket = bucket.when(score.between(low, high), name)
    bucket = bucket.otherwise("Unknown")
    return articles.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def score_overview(articles: DataFrame, score: Column, perfect: Column, lolbas: Column) -> DataFrame:
    """Mean of positive scores, how many exceed 50, and how many articles hold a perfect or a lolbas keyword."""
    rows = articles.select(score.alias("hs"), perfect.alias("p"), lolbas.alias("l"))
    positive = F.when(F.col("hs") > 0, F.col("hs"))
    return rows.agg(
        exact_mean(positive, 10).alias("avg_score"), F.count_if(F.col("hs") > 50).alias("above_50"), F.count_if("p").alias("with_perfect"), F.count_if("l").alias("with_lolbas")
    )


def score_trend(articles: DataFrame, score: Column) -> DataFrame:
    rows = articles.select(F.to_date("discovered_at").alias("day"), score.alias("hs"))
    return rows.groupBy("day").agg(exact_mean(F.when(F.col("hs") > 0, F.col("hs")), 10).alias("avg_score"), F.count(F.lit(1)).alias("n"))


def per_source(articles: DataFrame) -> DataFrame:
    """Articles, mean length and days with articles of each source."""
    return articles.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), exact_mean(F.length("content").cast("double"), 1).alias("avg_length"), F.countDistinct(F.to_date("discovered_at")).alias("days")
    )


def coverage(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per source how many articles have a vector, and their percentage."""
    stored = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").alias("article_id")).distinct().withColumn("has", F.lit(1))
    rows = articles.select("article_id", "source").join(stored, "article_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("has").alias("embedded"))
    return rows.withColumn("percent", F.round(F.col("embedded") * 100.0 / F.col("total"), 2))


def annotation_stats(annotations: DataFrame) -> DataFrame:
    """Annotations by type with their share of all."""
    counts = annotations.groupBy("annotation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    total = annotations.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("annotation_type", "n", "toxic", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percent"))  # total is one row


def ingestion_health(checks: DataFrame) -> DataFrame:
    """Sources by their newest check, uptime (healthy + half of warning) and the state that follows from it."""
    newest = checks.groupBy("source_id").agg(F.max(F.struct("check_time", "check_id", "success")).alias("last"), F.count_if(~F.col("success")).alias("failed"))
    state = F.when(~F.col("last.success"), "critical").when(F.col("failed") > 0, "warning").otherwise("healthy")
    counts = newest.groupBy().agg(*(F.count_if(state == s).alias(s) for s in ("healthy", "warning", "critical")), F.count(F.lit(1)).alias("monitored"))
    uptime = F.round((F.col("healthy") + 0.5 * F.col("warning")) * 100 / F.col("monitored"), 2)
    worst = F.col("critical") >= F.greatest(F.lit(3), F.ceil(F.col("monitored") * 0.2))
    return counts.select("*", uptime.alias("uptime"), F.when(worst, "critical").when(uptime >= 90, "nominal").otherwise("degraded").alias("state"))


def series(rows: DataFrame, start: str, days: int) -> DataFrame:
    """Counts of each of so many days from start, empty ones included."""
    every = rows.sparkSession.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    counted = rows.groupBy(F.to_date("discovered_at").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    return every.join(counted, "day", "left").select("day", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def errors_by_version(rows: DataFrame, key: str, expected: Column, actual: Column) -> DataFrame:
    """Per version: mean absolute and squared error of whole numbers, and how many are exact, within two, and beyond."""
    e = actual - expected
    off = F.abs(e)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(off) / F.count(off), 4).alias("mae"), F.round(F.sum(e * e) / F.count(e), 4).alias("mse"),
        F.count_if(off == 0).alias("exact"), F.count_if((off > 0) & (off <= 2)).alias("within_two"), F.count_if(off > 2).alias("beyond"),
    )


def usage_counts(rows: DataFrame, key: str, used: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(used).alias("used"), F.count_if(~used).alias("unused"))


def merged_first(*sources: DataFrame, key: str) -> DataFrame:
    """Rows of several sources: of one key the row of the first source counts, and in it the least; blank keys are all kept."""
    every = None
    for i, s in enumerate(sources):
        tagged = s.withColumn("_source", F.lit(i))
        every = tagged if every is None else every.unionByName(tagged)
    columns = sources[0].columns
    plain = F.regexp_replace(F.coalesce(key, F.lit("")), "/+$", "")
    first = every.where(plain != "").groupBy(plain.alias("_key")).agg(F.min(F.struct("_source", *columns)).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in columns))
    return first.unionByName(every.where(plain == "").select(*columns))


def insert_missing(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The stored table with those rows whose key it lacks, one for each key (the least)."""
    columns = [c for c in stored.columns if c != key]
    fresh = rows.join(stored.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*columns)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))
    return stored.select(key, *columns).unionByName(fresh)


def upsert(stored: DataFrame, rows: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """The stored table with the updated columns taken from rows of the same key (the least of several), and with the rows of new keys."""
    columns = [c for c in stored.columns if c != key]
    new = rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("r"))
    both = stored.select(key, F.struct(*columns).alias("s")).join(new, key, "full")
    pick = lambda c: F.when(F.col("r").isNotNull() & F.col("s").isNotNull(), F.col(f"r.{c}" if c in updated else f"s.{c}")).otherwise(F.coalesce(f"s.{c}", f"r.{c}"))
    return both.select(key, *(pick(c).alias(c) for c in columns))


def retained(rows: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than so many days; the bound is a constant, so it reaches the scan."""
    return rows.where(F.col(column) >= F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {int(days)} DAY"))


def cascade_delete(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose parent isn't deleted."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")
