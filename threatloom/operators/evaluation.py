"""Scoring of extracted items and spans, and metrics kept as long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.operators import spans


def item_key(item: Column) -> Column:
    """Lower case, trimmed, [.] and [:] as . and :, runs of white space as one space."""
    c = F.regexp_replace(F.lower(item), r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")
    c = F.replace(F.replace(c, F.lit("[.]"), F.lit(".")), F.lit("[:]"), F.lit(":"))
    return F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " ")


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), 4), F.lit(0.0))


def item_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Precision and recall of each article's items (article_id, item) by key; an empty key counts nowhere.

    One grouping over both sides: a key is matched if it stands on both.
    """
    side = lambda df, name: df.select("article_id", item_key(F.col("item")).alias("key"), F.lit(name).alias("side")).where("key <> ''")
    keys = side(expected, "e").unionByName(side(actual, "a")).groupBy("article_id", "key")
    keys = keys.agg(F.count_if(F.col("side") == "e").alias("e"), F.count_if(F.col("side") == "a").alias("a"))
    counts = keys.groupBy("article_id").agg(
        F.count_if((F.col("e") > 0) & (F.col("a") > 0)).alias("matched"), F.count_if(F.col("a") == 0).alias("missed"), F.count_if(F.col("e") == 0).alias("extra")
    )
    return counts.withColumns({"precision": ratio(F.col("matched"), F.col("matched") + F.col("extra")), "recall": ratio(F.col("matched"), F.col("matched") + F.col("missed"))})


def span_overlap(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairs of gold and predicted spans (article_id, start, end) of an article that overlap, with the Jaccard share of their characters.

    Spans are dealt to cells of CELL characters, so pairs meet only where they lie near each other; a pair counts in the first cell it shares.
    """
    cell = 1_000
    cells = lambda df, x: df.select(
        "article_id", F.col("start").alias(f"{x}_start"), F.col("end").alias(f"{x}_end"),
        F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / cell))).alias("cell"),
    )
    both = cells(gold, "gold").join(cells(predicted, "pred"), ["article_id", "cell"])
    low, high = F.greatest("gold_start", "pred_start"), F.least("gold_end", "pred_end")
    both = both.where((low < high) & (F.col("cell") == F.floor(low / cell)))
    union = F.greatest("gold_end", "pred_end") - F.least("gold_start", "pred_start")
    return both.select("article_id", "gold_start", "gold_end", "pred_start", "pred_end", F.round((high - low) / union, 6).alias("overlap"))


def span_metrics(gold: DataFrame, predicted: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The measures of each article under a greedy match by places: every gold span in its order takes the best prediction that is left and overlaps enough."""
    span = lambda x: F.struct(F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end")).alias(x)
    delta = (F.col("pred_end") - F.col("pred_start") - F.col("gold_end") + F.col("gold_start")).alias("delta")
    pairs = span_overlap(gold, predicted).where(F.col("overlap") >= threshold).select("article_id", span("gold"), span("pred"), "overlap", delta)
    distinct = lambda rows: rows.select("article_id", "start", "end").distinct()
    return spans.measures(distinct(gold), distinct(predicted), spans.greedy(pairs)).drop("micro", "deltas")


def metric_rows(wide: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Metrics as long rows of name and value."""
    return wide.select(key, F.inline(F.array(*(F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value")) for m in metrics))))


def metric_comparison(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Metrics of two runs side by side: the difference, its percentage, and what it means beyond a thousandth."""
    joined = before.select(key, "metric_name", F.col("metric_value").alias("a")).join(after.select(key, "metric_name", F.col("metric_value").alias("b")), [key, "metric_name"])
    diff = F.round(F.col("b") - F.col("a"), 6)
    change = F.when(F.abs(diff) < 0.001, "unchanged").when(diff > 0, "improvement").otherwise("degradation")
    return joined.select(key, "metric_name", diff.alias("diff"), F.round(F.try_divide(diff * 100, F.col("a")), 4).alias("percent"), change.alias("change"))


def misclassified(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    return rows.where(truth != predicted)


def newest_version(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key, by pre-aggregation: no key is sorted in one task."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)))


def metric_trend(rows: DataFrame, key: str, time: str, value: Column) -> DataFrame:
    """A value with the one before it in time, within each key."""
    w = Window.partitionBy(key).orderBy(time)
    return rows.select(key, time, value.alias("value")).withColumn("before", F.lag("value").over(w))
