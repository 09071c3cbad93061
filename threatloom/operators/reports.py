"""Reporting aggregations. Each takes and returns DataFrames; none looks at the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.text import hunt_score, matches
from threatloom.operators.selection import medians
from threatloom.session import written
from threatloom.views import pct

count_if = F.count_if


def exact_mean(value: Column, scale: int) -> Column:
    """A mean of values with scale-th parts, to two digits: summed as whole numbers, so the order of rows can't matter."""
    mean = F.sum(F.round(value * scale).cast("long")) / F.count(value) / scale
    return F.floor(mean * 100 + 0.5) / 100.0


def source_quality_stats(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per source: articles, chosen, rejected and unclassified ones, and the two rates."""
    known = annotations.groupBy("article_id").agg(F.max("quality").alias("quality"))
    joined = articles.select("article_id", "source").join(known, "article_id", "left")
    counted = joined.groupBy("source").agg(
        F.count("article_id").alias("total_articles"),
        count_if(F.col("quality") == 0).alias("rejected_count"),
        count_if(F.col("quality") == 1).alias("chosen_count"),
        count_if(F.col("quality").isNull()).alias("unclassified_count"),
    )
    return counted.withColumns(
        {"rejection_rate": pct(F.col("rejected_count"), F.col("total_articles")), "acceptance_rate": pct(F.col("chosen_count"), F.col("total_articles"))}
    )


def source_score_stats(articles: DataFrame) -> DataFrame:
    """Per source: scored articles, average and largest keyword score."""
    scored = articles.select("source", hunt_score(F.col("content")).alias("hs"))
    positive = F.when(F.col("hs") > 0, F.col("hs"))
    return scored.groupBy("source").agg(
        F.count(positive).alias("scored"), exact_mean(positive, 10).alias("avg_score"), F.max("hs").alias("max_score")
    )


def daily_trend(checks: DataFrame) -> DataFrame:
    return checks.groupBy(F.to_date("check_time").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"))


def hourly_distribution(checks: DataFrame) -> DataFrame:
    """All 24 hours of the day, also those without a row."""
    hours = checks.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counted = checks.groupBy(F.hour("check_time").alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def score_bands_daily(checks: DataFrame) -> DataFrame:
    """Values by day and band; a value between two bands (79.5) is in none."""
    v = F.col("response_time")
    return checks.groupBy(F.to_date("check_time").alias("day")).agg(
        count_if(v >= 80).alias("excellent"),
        count_if(v.between(60, 79)).alias("good"),
        count_if(v.between(40, 59)).alias("average"),
        count_if(v.between(20, 39)).alias("poor"),
        count_if((v < 20) | v.isNull()).alias("low"),
    )


def check_overview(checks: DataFrame) -> DataFrame:
    rt = F.when(F.col("response_time") > 0, F.col("response_time"))
    counts = checks.agg(F.count(F.lit(1)).alias("total"), count_if(~F.col("success")).alias("failed"), F.lit(0).alias("__all"))
    median = medians(checks.withColumn("__all", F.lit(0)), "__all", rt)
    joined = counts.join(median, "__all", "left").select("total", "failed", F.round("median", 6).alias("median_response"))
    return joined.withColumn("error_rate", pct(F.col("failed"), F.col("total"), 2))


def check_by_source(checks: DataFrame) -> DataFrame:
    rt = F.when(F.col("response_time") > 0, F.col("response_time"))
    counts = checks.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), count_if(~F.col("success")).alias("failed"))
    median = medians(checks, "source_id", rt).select(F.col("source_id").alias("__source"), F.round("median", 6).alias("median_response"))
    return counts.join(median, F.col("source_id").eqNullSafe(F.col("__source")), "left").drop("__source")


def source_health(checks: DataFrame) -> DataFrame:
    """Days since the last good check, as of the newest check: healthy, warning up to 2, else error."""
    as_of = checks.agg(F.max("check_time").alias("as_of"))
    last = checks.groupBy("source_id").agg(F.max(F.when(F.col("success"), F.col("check_time"))).alias("last_success"))
    days = F.datediff(F.to_date("as_of"), F.to_date("last_success"))
    status = F.when(days <= 0, "healthy").when(days <= 2, "warning").otherwise("error")
    return last.crossJoin(F.broadcast(as_of)).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def running_health(checks: DataFrame) -> DataFrame:
    """Consecutive failures at the end of each source's checks, in time order: those after its last good check.

    Two pre-aggregated groupings, so no task sorts a source's checks. The last good checks are one row for each source.
    """
    at = F.struct("check_time", "check_id")
    last = checks.groupBy("source_id").agg(F.max(F.when(F.col("success"), at)).alias("good"))
    # Without a good check all failures count; a source without failures keeps its row.
    failed = checks.where(~F.col("success")).select("source_id", at.alias("at")).join(last, "source_id")
    tail = failed.where(F.col("good").isNull() | (F.col("at") > F.col("good"))).groupBy("source_id").agg(F.count(F.lit(1)).alias("f"))
    return last.join(tail, "source_id", "left").select("source_id", F.coalesce("f", F.lit(0)).cast("long").alias("consecutive_failures"))


def score_range(score: Column) -> Column:
    """Seven ordered ranges of a score."""
    return (
        F.when(score.isNull() | (score == 0), "0")
        .when(score < 20, "1-19")
        .when(score < 40, "20-39")
        .when(score < 60, "40-59")
        .when(score < 80, "60-79")
        .when(score < 100, "80-99")
        .otherwise("100")
    )


def quality_distribution(articles: DataFrame) -> DataFrame:
    """Articles by range of the keyword score, empty ranges included."""
    spark = articles.sparkSession
    ranges = spark.sql("SELECT * FROM VALUES ('0', 1), ('1-19', 2), ('20-39', 3), ('40-59', 4), ('60-79', 5), ('80-99', 6), ('100', 7) AS t(score_range, position)")
    counted = articles.groupBy(score_range(hunt_score(F.col("content"))).alias("score_range")).agg(F.count(F.lit(1)).alias("c"))
    return ranges.join(counted, "score_range", "left").select("score_range", "position", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def keyword_stats(articles: DataFrame, registry: dict[str, list[str]]) -> DataFrame:
    """Frequency and average score of each keyword and tier."""

    def tagged(tier: str, words: list[str]) -> Column:
        return F.transform(matches(F.col("content"), words), lambda w: F.struct(F.lit(tier).alias("category"), w.alias("keyword")))

    pairs = F.flatten(F.array(*(tagged(tier, words) for tier, words in registry.items())))
    hits = articles.select(hunt_score(F.col("content"), registry).alias("hs"), F.explode(pairs).alias("k"))
    return hits.groupBy("k.category", "k.keyword").agg(
        F.count(F.lit(1)).alias("frequency"), exact_mean(F.col("hs"), 10).alias("avg_impact")
    )


def status_counts(executions: DataFrame) -> DataFrame:
    return executions.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), exact_mean(F.col("ranking_score"), 100).alias("avg_score"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )


def newest_per_key(executions: DataFrame) -> DataFrame:
    """The newest execution of each article; ties go to the larger id."""
    w = Window.partitionBy("article_id").orderBy(F.desc("created_at"), F.desc("execution_id"))
    return executions.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def version_comparison(executions: DataFrame) -> DataFrame:
    """Attempts and average score of each article under the two statuses, side by side."""
    side = lambda s, x: executions.where(F.col("status") == s).groupBy("article_id").agg(F.count(F.lit(1)).alias(f"attempts_{x}"), exact_mean(F.col("ranking_score"), 100).alias(f"avg_{x}"))
    both = side("O", "a").join(side("F", "b"), "article_id", "full")
    return both.select("article_id", F.coalesce("attempts_a", F.lit(0)).cast("long").alias("attempts_a"), F.coalesce("attempts_b", F.lit(0)).cast("long").alias("attempts_b"), "avg_a", "avg_b")


def metric_pivot(checks: DataFrame) -> DataFrame:
    """One row for each source with a column for each method's count."""
    methods = ["click", "error", "purchase", "signup", "view"]
    return checks.groupBy("source_id").pivot("method", methods).agg(F.count(F.lit(1))).select("source_id", *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in methods))


def confusion(annotations: DataFrame) -> DataFrame:
    """quality taken as the truth, not toxic as the prediction: the four cells and what follows from them."""
    t, p = F.col("quality") == 1, F.col("toxic") == 0
    cells = annotations.agg(count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"), count_if(t & ~p).alias("fn"), count_if(~t & ~p).alias("tn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return cells.select(
        "tp", "fp", "fn", "tn",
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(F.try_divide(2 * precision * recall, precision + recall), 4).alias("f1"),
        F.round(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4).alias("accuracy"),
    )


def model_agreement(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """How the label and the keyword rule agree; the 'precision' here divides by the model's rows, as its users expect."""
    scored = articles.select("article_id", (hunt_score(F.col("content")) > 0).alias("rule"))
    both = annotations.select("article_id", (F.col("quality") == 1).alias("model")).join(scored, "article_id")
    return both.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("model") == F.col("rule")).alias("agreement"),
        count_if(F.col("model") & ~F.col("rule")).alias("model_only"),
        count_if(~F.col("model") & F.col("rule")).alias("rule_only"),
    ).withColumn("accuracy", pct(F.col("agreement"), F.col("total"), 2))


def conversation_metrics(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 2).alias("avg_chars"), F.max("turn").alias("max_turn")
    )


def numbered_export(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations in order, with a running number and the article's title. A global order is the export's contract.

    The number comes from range-partitioned blocks: each partition counts its rows, and the offsets of the
    partitions before are added, so no task sorts all rows. The blocks are written once, since another run of
    the range partitioning may draw other bounds.
    """
    parts = annotations.repartitionByRange(F.col("article_id"), F.col("annotation_type")).withColumn("part", F.spark_partition_id())
    parts = written(parts, "numbered")
    parts = parts.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("article_id", "annotation_type")))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = parts.join(F.broadcast(before.select("part", "offset")), "part").withColumn("record_number", F.col("rn") + F.col("offset"))
    return numbered.join(articles.select("article_id", "title"), "article_id", "left").select("record_number", "article_id", "annotation_type", "title")


def corpus_stats(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"), F.sum(F.length("content")).alias("chars"),
        F.min("discovered_at").alias("first_at"), F.max("discovered_at").alias("last_at"),
    )
