"""Matching of annotated and predicted spans: token overlap, a greedy one-to-one match in one pass over sorted rows, relaxed and strict measures.

Spans are rows (article_id, idx, text); idx orders the spans of an article. They are shuffled once, by article; what follows sorts, groups and
counts within the article's partition (Spark spills what is too large), so neither words nor texts are shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.strings import span_form
from threatloom.session import map_rows


def tokens(text: Column) -> Column:
    """The distinct words of a normal form; an empty text has the empty word, so that only empty texts are like it."""
    return F.array_distinct(F.split(span_form(text), " "))


#: Tasks for each of the session's shuffle partitions: an article's spans grow much when they are cut into words, long after the shuffle.
SPREAD = 4


def by_article(rows: DataFrame) -> DataFrame:
    """The rows with each article's in one partition; the number of partitions is given, as their size says little about the work."""
    return rows.repartition(SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "article_id")


def both_sides(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The spans of both sides (article_id, is_gold, idx, text), each article's in one partition."""
    side = lambda rows, is_gold: rows.select("article_id", F.lit(is_gold).alias("is_gold"), "idx", "text")
    return by_article(side(gold, True).unionByName(side(predicted, False)))


def token_pairs(gold: DataFrame, predicted: DataFrame, *, threshold: float) -> DataFrame:
    """article_id, gold, pred (their idx), overlap and delta (in characters) of spans whose words have a Jaccard similarity of threshold or more.

    Prefix filtering: of each span's words, rarest of the article first, only as many are looked up as two similar spans must share one of.
    Words are numbered by that order within their article, so that spans meet and are compared as sets of numbers.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0, and 1 at most")
    spans = both_sides(gold, predicted).select("article_id", "is_gold", "idx", F.length(span_form(F.col("text"))).alias("chars"), tokens(F.col("text")).alias("set"))
    words = spans.select("article_id", "is_gold", "idx", "chars", F.explode("set").alias("word"))
    often = words.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("article_id", "word")))
    numbered = often.select("article_id", "is_gold", "idx", "chars", F.dense_rank().over(Window.partitionBy("article_id").orderBy("n", "word")).alias("word"))
    sets = numbered.groupBy("article_id", "is_gold", "idx").agg(F.first("chars").alias("chars"), F.array_sort(F.collect_list("word")).alias("s"))
    size = F.size("s")
    # Rounded first, so that 0.8 * 5 isn't taken for more than 4.
    keys = sets.select("article_id", "is_gold", F.struct("idx", "chars", "s").alias("span"), F.explode(F.slice("s", F.lit(1), size - F.ceil(F.round(size * threshold, 9)).cast("int") + 1)).alias("key"))
    lists = keys.groupBy("article_id", "key").agg(*(F.collect_list(F.when(F.col("is_gold") == is_gold, F.col("span"))).alias(name) for name, is_gold in (("gold", True), ("pred", False))))
    met = lists.select("article_id", "key", F.explode("gold").alias("g"), "pred").select("article_id", "key", "g", F.explode("pred").alias("p"))
    shared = F.array_intersect("g.s", "p.s")
    both = F.size(shared)
    either = F.size("g.s") + F.size("p.s") - both
    # A pair counts at the first word that it shares: similar spans share one within both of their prefixes, and the first such is their first of all.
    pairs = met.where((F.col("key") == F.array_min(shared)) & (both >= F.round(either * threshold, 9)))
    return pairs.select("article_id", F.col("g.idx").alias("gold"), F.col("p.idx").alias("pred"), (both / either).alias("overlap"), (F.col("p.chars") - F.col("g.chars")).alias("delta"))


def greedy(pairs: DataFrame) -> DataFrame:
    """Of pairs (article_id, gold, pred, overlap, ...) those that a greedy match takes: in order, each gold span takes the best pred that is left.

    Ties go to the first pred. An article's pairs come sorted by gold span, the best first, so one pass takes each pair of which neither side
    is taken; a task only holds the preds taken in the article that it is at.
    """
    named = pairs.withColumns({"__article": F.col("article_id").cast("string"), "__gold": F.col("gold").cast("string"), "__pred": F.col("pred").cast("string")})
    ordered = by_article(named).sortWithinPartitions("article_id", "gold", F.desc("overlap"), "pred")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        article, last, taken = object(), object(), set()
        for batch in batches:
            keep = []
            for a, g, p in zip(*(batch.column(name).to_pylist() for name in ("__article", "__gold", "__pred")), strict=True):
                if a != article:
                    article, last, taken = a, object(), set()
                keep.append(g != last and p not in taken)
                if keep[-1]:
                    last = g
                    taken.add(p)
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["__article", "__gold", "__pred"])

    return map_rows(ordered, run, pairs.schema)


def mean(total: Column, n: Column, digits: int) -> Column:
    """A mean of whole numbers, rounded half up; 0 without any."""
    return F.coalesce(F.floor(F.try_divide(total, n) * 10**digits + 0.5) / 10**digits, F.lit(0.0))


def measures(gold: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """Of each article the true and false positives and the misses, the mean overlap and difference of length of its matches, precision and recall.

    gold and predicted have a row for each span, matches overlap and delta of each match.
    """
    count = lambda rows, name: rows.groupBy("article_id").agg(F.count(F.lit(1)).alias(name))
    # Millionths are added, so that the order of rows can't matter.
    summed = matches.groupBy("article_id").agg(F.count(F.lit(1)).alias("tp"), F.sum(F.round(F.col("overlap") * 1_000_000).cast("long")).alias("micro"), F.sum("delta").alias("delta"))
    rows = count(gold, "n_gold").join(count(predicted, "n_pred"), "article_id", "full").join(summed, "article_id", "left").fillna(0)
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gold") - F.col("tp")
    rows = rows.select("article_id", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), mean(F.col("micro") / 1_000_000, tp, 4).alias("mean_overlap"), mean(F.col("delta"), tp, 4).alias("mean_delta"), "micro", F.col("delta").alias("deltas"))
    return rows.withColumns({"precision": mean(F.col("tp"), F.expr("tp + fp"), 4), "recall": mean(F.col("tp"), F.expr("tp + fn"), 4)})


def span_metrics(gold: DataFrame, predicted: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The relaxed measures of each article, by the words of its spans."""
    return measures(gold, predicted, greedy(token_pairs(gold, predicted, threshold=threshold)))


def totals(metrics: DataFrame) -> DataFrame:
    """The measures of all articles together, and the share of articles with a false positive."""
    t = metrics.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "micro", "deltas")), F.count(F.lit(1)).alias("articles"), F.count_if(F.col("fp") > 0).alias("with_fp"))
    return t.select(
        "tp", "fp", "fn", "articles", mean(F.col("tp"), F.expr("tp + fp"), 4).alias("precision"), mean(F.col("tp"), F.expr("tp + fn"), 4).alias("recall"), mean(F.col("tp") * 2, F.expr("2 * tp + fp + fn"), 4).alias("f1"),
        mean(F.col("micro") / 1_000_000, F.col("tp"), 4).alias("mean_overlap"), mean(F.col("deltas"), F.col("tp"), 4).alias("mean_delta"), mean(F.col("with_fp"), F.col("articles"), 4).alias("fp_rate_per_document"),
    )


def gold_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The strict measures of each article: spans match if they are equal but for outer white space and kinds of quotes.

    Equal spans are interchangeable, so the k-th span of a text matches the k-th prediction of that text. merged counts unmatched gold spans for
    which a prediction half as long again is left when their turn comes, truncated those with a prediction under 0.7 of their length, and
    argument_hallucinations the predictions of more than three words whose words neither hold nor are held by those of any gold span.
    An article without gold spans only has hallucinations. (Matched spans are equal, so over- and under-extraction are always 0.)
    """
    rows = both_sides(gold, predicted).select("article_id", "is_gold", "idx", span_form(F.col("text"), strict=True).alias("form"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("article_id", "is_gold", "form").orderBy("idx")))
    same = Window.partitionBy("article_id", "form", "k")  # one gold span and one prediction at most
    is_gold = F.col("is_gold")
    rows = rows.withColumns({"hit": F.count(F.lit(1)).over(same) > 1, "until": F.max(F.when(is_gold, F.col("idx"))).over(same)})
    # A prediction is left until the gold span that it matches has had its turn, and for good if it matches none.
    turns = rows.select("article_id", "is_gold", "hit", F.length("form").alias("chars"), F.coalesce("until", F.lit(2**62)).cast("long").alias("at"))
    own = Window.partitionBy("article_id")
    later = own.orderBy(F.desc("at"), "is_gold").rowsBetween(Window.unboundedPreceding, 0)
    predicted_chars = F.when(~is_gold, F.col("chars"))
    turns = turns.withColumn("longest", F.max(predicted_chars).over(later)).withColumn("shortest", F.min(predicted_chars).over(own))
    counted = turns.groupBy("article_id").agg(
        F.count_if(is_gold).alias("n_gold"), F.count_if(~is_gold).alias("n_pred"), F.count_if(is_gold & F.col("hit")).alias("exact"),
        F.count_if(is_gold & ~F.col("hit") & (F.col("longest") > F.col("chars") * 1.5)).alias("merged"), F.count_if(is_gold & (F.col("shortest") < F.col("chars") * 0.7)).alias("truncated"),
    )
    odd = unheld(rows).groupBy("article_id").agg(F.count(F.lit(1)).alias("argument_hallucinations"))
    measured = counted.join(odd, "article_id", "left").fillna(0)
    measured = measured.select("article_id", "n_gold", "n_pred", "exact", (F.col("n_pred") - F.col("exact")).alias("hallucinations"), "merged", "truncated", F.when(F.col("n_gold") > 0, F.col("argument_hallucinations")).otherwise(0).cast("long").alias("argument_hallucinations"))
    return measured.withColumn("zero_fp_pass", F.col("hallucinations") == 0)


def unheld(rows: DataFrame) -> DataFrame:
    """article_id and idx of predictions with more than three words that neither hold nor are held by any gold span's. rows: both sides by article, with form and hit.

    A set that is held meets its holder at each of its words, so at the rarest one of its article. What matches a gold span is held by it.
    """
    words = F.array_distinct(F.filter(F.split("form", r"\s+"), lambda w: w != ""))
    sets = rows.select("article_id", "is_gold", "idx", "hit", words.alias("words"))
    sets = sets.withColumn("every", F.max(F.col("is_gold") & (F.size("words") == 0)).over(Window.partitionBy("article_id")))
    # A gold span without words is held by every prediction of its article.
    sets = sets.where(~F.col("every") & (F.col("is_gold") | (~F.col("hit") & (F.size("words") > 3))))
    often = sets.select("article_id", "is_gold", "idx", F.explode("words").alias("word")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("article_id", "word")))
    numbered = often.select("article_id", "is_gold", "idx", F.dense_rank().over(Window.partitionBy("article_id").orderBy("n", "word")).alias("word"))
    sets = numbered.groupBy("article_id", "is_gold", "idx").agg(F.array_sort(F.collect_list("word")).alias("s"))
    each = sets.select("article_id", "is_gold", "idx", F.col("s")[0].alias("rarest"), F.explode("s").alias("word"))
    listed = lambda is_gold, rare: F.collect_list(F.when((F.col("is_gold") == is_gold) & (F.col("rarest") == F.col("word") if rare else F.lit(True)), F.col("idx")))
    lists = each.groupBy("article_id", "word").agg(listed(True, False).alias("golds"), listed(True, True).alias("rare_golds"), listed(False, False).alias("preds"), listed(False, True).alias("rare_preds"))
    crossed = lambda golds, preds: F.flatten(F.transform(preds, lambda p: F.transform(golds, lambda g: F.struct(g.alias("gold"), p.alias("pred")))))
    met = lists.select("article_id", F.inline(F.concat(crossed("golds", "rare_preds"), crossed("rare_golds", "preds")))).distinct()
    side = lambda is_gold, name, held: sets.where(F.col("is_gold") == is_gold).select("article_id", F.col("idx").alias(name), F.col("s").alias(held))
    full = met.join(side(True, "gold", "a"), ["article_id", "gold"]).join(side(False, "pred", "b"), ["article_id", "pred"])
    both = F.size(F.array_intersect("a", "b"))
    held = full.where((both == F.size("a")) | (both == F.size("b"))).select("article_id", F.col("pred").alias("idx")).distinct()
    return sets.where(~F.col("is_gold")).select("article_id", "idx").join(held, ["article_id", "idx"], "left_anti")


def gold_totals(metrics: DataFrame) -> DataFrame:
    """The strict rates over all gold spans, and the share of articles without a false positive."""
    names = ("n_gold", "exact", "hallucinations", "merged", "truncated", "argument_hallucinations")
    t = metrics.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), F.count(F.lit(1)).alias("articles"), F.count_if("zero_fp_pass").alias("passing"), F.count_if(F.col("n_gold") == 0).alias("without_gold"), F.max("merged").alias("most_merged"))
    rate = lambda c: mean(F.col(c), F.col("n_gold"), 4)
    return t.select(
        rate("exact").alias("exact_match_rate"), F.lit(0.0).alias("over_extraction_rate"), F.lit(0.0).alias("under_extraction_rate"), rate("hallucinations").alias("hallucination_rate"), rate("merged").alias("merge_rate"),
        mean(F.col("passing"), F.col("articles"), 4).alias("zero_fp_pass_rate"), F.col("n_gold").alias("sample_count"), "articles", "exact", "hallucinations", F.col("merged").alias("merges"), "truncated", "argument_hallucinations", "passing", "without_gold", "most_merged",
    )


def failure_rows(metrics: DataFrame) -> DataFrame:
    """The failures of each article as rows (article_id, failure_type, n)."""
    kinds = {
        "hallucination_on_empty": F.when(F.col("n_gold") == 0, F.col("hallucinations")).otherwise(0), "merged_commands": F.col("merged"), "truncated_span": F.col("truncated"), "argument_hallucination": F.col("argument_hallucinations"),
    }
    return metrics.select("article_id", F.inline(F.array(*(F.struct(F.lit(k).alias("failure_type"), n.cast("long").alias("n")) for k, n in kinds.items())))).where("n > 0")
