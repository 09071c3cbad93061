"""Scores of single rules over tables of their detection values: huntability, false-positive risk, tokens; groups of observables; sources.

values are rows (rule_id, field, value, in_list); rules rows (rule_id, tags, description, category, product).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of the five parts of the score, and log sources that certainly exist.
WEIGHTS = {"commandline_specificity": 0.25, "ttp_clarity": 0.20, "parent_child": 0.15, "telemetry_feasibility": 0.15, "overfitting": 0.25}
KNOWN_SOURCES = (("process_creation", "windows"), ("process_creation", "linux"), ("network_connection", "windows"), ("registry_access", "windows"))
# Addresses and host names, which age faster than behaviour.
ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
HOST = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
# Names of platforms as they are written.
PLATFORM_NAMES = {"windows": "windows", "win": "windows", "linux": "linux", "macos": "macos", "mac": "macos", "mac_os": "macos", "darwin": "macos", "osx": "macos", "mac_os_x": "macos", "multiple": "cross-platform", "multi": "cross-platform", "cross_platform": "cross-platform", "crossplatform": "cross-platform", "platform_agnostic": "cross-platform"}


def value_tokens(value: Column) -> Column:
    """The words of a detection value, without wildcards and quotes: longer than two characters, no placeholders, each once, in order."""
    cleaned = F.regexp_replace(F.coalesce(value, F.lit("")), r"[*?|&<>\"']", " ")
    parts = F.transform(F.split(cleaned, r"(?U)[\s,;:/=]+"), F.lower)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: (F.length(p) > 2) & ~F.startswith(p, F.lit("<")) & ~F.endswith(p, F.lit(">")))))


def huntability(rules: DataFrame, values: DataFrame) -> DataFrame:
    """The five parts (0 to 10), the score (0 to 10), the risk of false positives and notes on what is weak.

    Values are added up by rule before the join. A rule without values has no detection: score 0, high risk.
    """
    field, text, alone = F.lower("field"), F.col("value"), ~F.coalesce("in_list", F.lit(False))
    bare = F.trim(F.replace(text, F.lit("*"), F.lit("")))
    command = F.contains(field, F.lit("command"))
    specific = ~F.contains(text, F.lit("*")) | (F.length(bare) > 10)
    image, parent = F.contains(field, F.lit("image")) & ~F.contains(field, F.lit("parent")), F.contains(field, F.lit("parentimage")) | F.contains(field, F.lit("parent_image"))
    star = F.trim(text).isin("*", ".*")
    found = lambda p: F.coalesce(F.rlike(text, F.lit("(?U)" + p)), F.lit(False)).cast("int")
    counted = values.groupBy("rule_id").agg(
        F.count_if(command).alias("commands"), F.count_if(command & text.isNotNull()).alias("written"), F.count_if(command & specific).alias("specific"), F.max(image).alias("image"), F.max(parent).alias("parent"),
        F.sum(F.when(star, 2).otherwise(0) + F.when(alone & (F.length(bare) < 3), 1).otherwise(0)).alias("risks"), F.sum(2 * found(ADDRESS) + found(HOST)).alias("signs"),
    )
    rows = rules.join(counted, "rule_id", "left")
    description = F.lower(F.coalesce("description", F.lit("")))
    category, product = F.coalesce("category", F.lit("")), F.coalesce("product", F.lit(""))
    known = F.lit(False)
    for c, p in KNOWN_SOURCES:
        known = known | ((category == c) & (product == p))
    parts = {
        "commandline_specificity": F.when(F.col("commands") == 0, 0.3).when(F.col("written") == 0, 0.5).otherwise(F.col("specific") / F.nullif("written", F.lit(0))),
        "ttp_clarity": F.least(F.lit(1.0), 0.5 + F.when(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit("attack."))), 0.3).otherwise(0.0) + F.when(F.length(description) > 50, 0.1).otherwise(0.0) + F.when(F.rlike(description, F.lit("ttp|technique")), 0.1).otherwise(0.0)),
        "parent_child": 0.5 + F.when(F.col("image"), 0.3).otherwise(0.0) + F.when(F.col("parent"), 0.2).otherwise(0.0),
        "telemetry_feasibility": F.when(known, 1.0).when((category != "") & (product != ""), 0.7).when((category != "") | (product != ""), 0.5).otherwise(0.3),
        "overfitting": F.when(F.col("signs") == 0, 1.0).when(F.col("signs") <= 1, 0.8).when(F.col("signs") <= 2, 0.6).otherwise(0.3),
    }
    there = F.col("commands").isNotNull()
    rows = rows.withColumns({k: F.when(there, v) for k, v in parts.items()})
    total = sum((F.col(k) * w for k, w in list(WEIGHTS.items())[1:]), F.col("commandline_specificity") * WEIGHTS["commandline_specificity"])
    risk = F.when(~there | (F.col("risks") >= 3), "high").when(F.col("risks") >= 1, "medium").otherwise("low")
    weak = [(F.col("commandline_specificity") < 0.5, "Low command-line specificity"), (F.col("ttp_clarity") < 0.5, "Limited TTP clarity"), (F.col("parent_child") < 0.5, "Weak parent/child process tracking"), (F.col("telemetry_feasibility") < 0.7, "Telemetry feasibility concerns"), (risk == "high", "High false-positive risk")]
    notes = F.array_join(F.array_compact(F.array(*(F.when(c, n) for c, n in weak))), "; ")
    text = F.when(~there, "No detection section").when(notes == "", "Good coverage across all categories").otherwise(notes)
    score = F.when(there, F.least(F.lit(10.0), F.greatest(F.lit(0.0), total * 10))).otherwise(0.0)
    return rows.select("rule_id", F.round(score, 6).alias("score"), risk.alias("false_positive_risk"), text.alias("coverage_notes"), *(F.round(F.col(k) * 10, 6).alias(k) for k in parts))


def review_summary(assessed: DataFrame, best: DataFrame) -> DataFrame:
    """What a reviewer sees of an assessment: the largest similarity, null where nothing could be said (no atoms, or candidates that share nothing).

    assessed is comparison.assess(), best has rule_id, class and similarity of the nearest match.
    """
    rows = assessed.join(best.select("rule_id", "class", "similarity"), "rule_id", "left")
    unsure = F.col("no_atoms") | ((F.col("evaluated") > 0) & (F.col("sharing") == 0))
    return rows.select("rule_id", F.when(~unsure, F.coalesce("similarity", F.lit(0.0))).alias("max_similarity"), "evaluated", "sharing", unsure.alias("inconclusive"), F.col("class").isNull().alias("logsource_unresolved"))


def platform_name(value: Column) -> Column:
    """A platform under its usual name; anything else is unknown."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[- ]", "_")
    names = F.create_map(*(F.lit(x) for kv in PLATFORM_NAMES.items() for x in kv))
    return F.coalesce(names[key], F.lit("unknown"))


def observable_groups(observables: DataFrame) -> DataFrame:
    """Observables (article_id, idx, platform, telemetry, logsource) of each article by platform, telemetry and log source: how many, their idx in order, and the first.

    Those without telemetry or log source can't be routed and stay out, as do those of macOS.
    """
    named = observables.withColumn("platform", platform_name(F.col("platform")))
    routed = named.where((F.col("platform") != "macos") & (F.coalesce("telemetry", F.lit("")) != "") & (F.coalesce("logsource", F.lit("")) != ""))
    return routed.groupBy("article_id", "platform", "telemetry", "logsource").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("idx")).alias("original_indices"), F.min("idx").alias("first"))


def source_metrics(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Every active source with its articles, their mean score and how many are classified; sources without articles stay."""
    # Tenths are added as whole numbers, so the order of rows can't matter.
    counted = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"), (F.sum(F.round(F.col("score") * 10).cast("long")) / F.count("score") / 10).alias("mean_score"), F.count("category").alias("classified"))
    active = sources.where("active").select("source_id", "name")
    return active.join(counted, "source_id", "left").select("source_id", "name", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce(F.round("mean_score", 6), F.lit(0.0)).alias("mean_score"), F.coalesce("classified", F.lit(0)).alias("classified"))


def source_list(sources: DataFrame, *, active: bool | None = None, identifier: str | None = None, name: str | None = None) -> DataFrame:
    """Sources by state and by parts of identifier and name, in order of name."""
    kept = sources if active is None else sources.where(F.col("active") == active)
    for column, part in (("identifier", identifier), ("name", name)):
        if part:
            kept = kept.where(F.contains(column, F.lit(part)))
    return kept.distinct().orderBy("name")
