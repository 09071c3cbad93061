"""How far rules cover the behaviours of articles: substring joins, overlaps and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.text import KEYWORDS, hunt_score, matches

#: Characters of the pieces by which texts are indexed.
GRAM = 4


def grams(text: Column, n: int) -> Column:
    """All pieces of n characters, overlapping ones too, in one pass."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))." % n), F.lit(1))


def substring_pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle and text, for each needle that stands in a text; both are columns of distinct, not null values; empty needles stand nowhere.

    A text that holds a needle holds all of its pieces. So a needle is looked up by the piece of its own that the fewest texts have,
    every pair is met once, and is then verified; a needle shorter than a piece is looked up by itself.
    """
    needles = needles.where(F.length("needle") > 0)
    own = F.when(F.length("needle") >= GRAM, F.array_distinct(grams(F.col("needle"), GRAM))).otherwise(F.array("needle"))
    pieces = needles.select("needle", F.explode(own).alias("gram"))
    every = reduce(F.array_union, (F.array_distinct(grams(F.col("text"), n)) for n in range(1, GRAM + 1)))
    held = texts.select("text", F.explode(every).alias("gram")).join(pieces.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # A piece that no text has rules its needle out.
    rarest = pieces.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("m")).where("m.texts > 0")
    met = rarest.select("needle", F.col("m.gram").alias("gram")).join(held, "gram")
    return met.where(F.contains("text", F.col("needle"))).select("needle", "text")


def related(behaviours: DataFrame, patterns: DataFrame) -> DataFrame:
    """behaviour and pattern, where one of them stands in the other."""
    b, p = behaviours.select("behaviour").distinct(), patterns.select("pattern").distinct()
    inside = substring_pairs(p.select(F.col("pattern").alias("needle")), b.select(F.col("behaviour").alias("text"))).select(F.col("text").alias("behaviour"), F.col("needle").alias("pattern"))
    around = substring_pairs(b.select(F.col("behaviour").alias("needle")), p.select(F.col("pattern").alias("text"))).select(F.col("needle").alias("behaviour"), F.col("text").alias("pattern"))
    return inside.unionByName(around.where(F.col("behaviour") != F.col("pattern")))


def article_behaviours(chunks: DataFrame, registry: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Of each article the words of each positive tier in any chunk, its chunks, and the mean and largest score of a chunk."""
    tiers = [t for t in registry if t != "negative"]
    scored = chunks.select("article_id", *(matches(F.col("chunk_text"), registry[t]).alias(t) for t in tiers), hunt_score(F.col("chunk_text"), registry).alias("score"))
    return scored.groupBy("article_id").agg(
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(t)))).alias(t) for t in tiers),
        F.count(F.lit(1)).alias("chunks"),
        # Tenths are added as whole numbers, so the order of rows can't matter.
        (F.sum(F.round(F.col("score") * 10).cast("long")) / F.count("score") / 10).alias("mean_score"),
        F.max("score").alias("largest_score"),
    )


def pattern_values(values: Column) -> Column:
    """Detection values as patterns: lower case, without stars around them, each once."""
    return F.array_distinct(F.transform(values, lambda v: F.regexp_replace(F.lower(v), r"^\*+|\*+$", "")))


def title_patterns(title: Column) -> Column:
    """The words of a rule's title that have more than four characters."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"[^ \t\r\n\f\x0B]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 4))


def overlaps(matches: DataFrame, behaviours: DataFrame, patterns: DataFrame) -> DataFrame:
    """matches (article_id, rule_id, similarity) with the article's behaviours, those that the rule's patterns meet, and their share.

    behaviours has article_id and behaviour, patterns has rule_id and pattern, all of them lower case.
    """
    owned = behaviours.where("behaviour IS NOT NULL").select("article_id", "behaviour").distinct()
    total = owned.groupBy("article_id").agg(F.count(F.lit(1)).alias("behaviours"))
    # A behaviour meets a rule if any of its patterns does; this is settled per behaviour and rule before articles come in.
    hit = related(owned, patterns.where("pattern IS NOT NULL")).join(patterns.select("rule_id", "pattern").distinct(), "pattern").select("rule_id", "behaviour").distinct()
    met = matches.select("article_id", "rule_id").distinct().join(owned, "article_id").join(hit, ["rule_id", "behaviour"])
    counted = met.groupBy("article_id", "rule_id").agg(F.count(F.lit(1)).alias("matched"))
    out = matches.join(total, "article_id", "left").join(counted, ["article_id", "rule_id"], "left").fillna(0, ["behaviours", "matched"])
    return out.withColumn("overlap", F.coalesce(F.try_divide("matched", "behaviours"), F.lit(0.0)))


def verdict(similarity: Column, overlap: Column) -> tuple[Column, Column]:
    """covered, extend or new (fixed values), and how sure that is."""
    mean = (similarity + overlap) / 2
    covered, extend = (similarity >= 0.85) & (overlap >= 0.7), (similarity >= 0.7) & (overlap >= 0.3)
    return F.when(covered, "covered").when(extend, "extend").otherwise("new"), F.when(covered, F.least(F.lit(0.9), mean)).when(extend, mean).otherwise(1 - mean)


def reasoning(matched: Column, behaviours: Column, similarity: Column, status: Column, mean_score: Column) -> Column:
    """The verdict in words."""
    counts = F.concat(F.lit("("), matched.cast("string"), F.lit("/"), behaviours.cast("string"), F.lit(" behaviors matched, "), F.format_string("%.2f", similarity), F.lit(" similarity)"))
    text = (
        F.when(status == "covered", F.concat(F.lit("Article behaviors are well covered by this rule "), counts))
        .when(status == "extend", F.concat(F.lit("Partial overlap detected "), counts, F.lit(". Rule could be extended to cover additional behaviors.")))
        .otherwise(F.concat(F.lit("Minimal overlap "), counts, F.lit(". Article represents new detection patterns.")))
    )
    high = F.concat(F.lit(" High hunt score ("), F.format_string("%.1f", mean_score), F.lit(") indicates valuable content."))
    return F.concat(text, F.when(F.coalesce(mean_score, F.lit(0.0)) > 70, high).otherwise(""))


def coverage(matches: DataFrame, behaviours: DataFrame, patterns: DataFrame, scores: DataFrame) -> DataFrame:
    """Each match with its overlap, status, confidence and reasoning; scores has article_id and mean_score."""
    rows = overlaps(matches, behaviours, patterns).join(scores.select("article_id", "mean_score"), "article_id", "left")
    status, sure = verdict(F.col("similarity"), F.col("overlap"))
    rows = rows.withColumns({"status": status, "confidence": F.round(sure, 8)})
    return rows.withColumn("reasoning", reasoning(F.col("matched"), F.col("behaviours"), F.col("similarity"), F.col("status"), F.col("mean_score")))
