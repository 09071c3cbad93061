"""Table changes as joins: configuration sync, field updates, usage flags, vector checks and version differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sync_plan(stored: DataFrame, configured: DataFrame, key: str, *, updated: list[str], owned: list[str], new_only: bool = False, remove_missing: bool = True) -> DataFrame:
    """What a sync does with each key: insert, update, keep or delete, with the values afterwards.

    Columns in updated come from the configuration; those in owned keep a stored value if there is one. With new_only, stored
    keys stay as they are. An empty stored table against a configuration isn't an error here: every key is an insert.
    """
    old = stored.select(key, F.lit(True).alias("_old"), *(F.col(c).alias(f"_old_{c}") for c in [*updated, *owned]))
    new = configured.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in [*updated, *owned]))
    both = old.join(new, key, "full")
    there, listed = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    action = (
        F.when(~there, "insert")
        .when(listed, F.lit("keep" if new_only else "update"))
        .otherwise("delete" if remove_missing else "keep")
    )
    from_stored = F.col("action").isin("keep", "delete")
    return both.withColumn("action", action).select(
        key,
        "action",
        *(F.when(from_stored, F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")).alias(c) for c in updated),
        *(F.when(from_stored, F.col(f"_old_{c}")).otherwise(F.coalesce(f"_old_{c}", f"_new_{c}")).alias(c) for c in owned),
    )


def patched(stored: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with the values that a patch gives; null in a patch leaves a value as it is. One patch a key."""
    new = patches.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = stored.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns))


def changed_once_set(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that break the rule that a value may not change once it is set."""
    new = after.select(key, F.col(column).alias("now"))
    joined = before.where(F.col(column).isNotNull()).select(key, F.col(column).alias("was")).join(new, key)
    return joined.where(~F.col("was").eqNullSafe(F.col("now")))


def take_unused(rows: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """The rows not used so far, and the table with all of them marked as used. A null flag is unused."""
    used = F.coalesce(F.col(flag), F.lit(False))
    return rows.where(~used), rows.withColumn(flag, F.lit(True))


def valid_vector(vector: Column, size: int) -> Column:
    """Whether a vector has the size and only finite numbers; false for null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def version_differences(metrics: DataFrame, old: str, new: str, *, least: float = 0.01) -> DataFrame:
    """Rows (version, metric, value) of two versions side by side: change, change in percent, and a verdict beyond least."""
    side = lambda v, name: metrics.where(F.col("version") == v).select("metric", F.col("value").alias(name))
    joined = side(old, "old_value").join(side(new, "new_value"), "metric")
    change = F.col("new_value") - F.col("old_value")
    verdict = F.when(change > least, "improved").when(change < -least, "worse").otherwise("same")
    percent = F.coalesce(F.try_divide(change * 100, F.col("old_value")), F.lit(0.0))
    return joined.select("metric", F.round(change, 4).alias("change"), F.round(percent, 1).alias("percent"), verdict.alias("verdict"))


def rule_set_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Precision and recall of each article's atoms, from rows (article_id, atom); 0 where there is nothing to divide by.

    Both sides are added up by (article, atom) first, so repeated atoms count once and no set is gathered.
    """
    marked = expected.select("article_id", "atom", F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select("article_id", "atom", F.lit(0).alias("e"), F.lit(1).alias("a")))
    once = marked.groupBy("article_id", "atom").agg(F.max("e").alias("e"), F.max("a").alias("a"))
    n = once.groupBy("article_id").agg(F.sum("e").alias("expected"), F.sum("a").alias("actual"), F.sum(F.col("e") * F.col("a")).alias("shared"))
    share = lambda whole: F.round(F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col(whole)), F.lit(0.0)), 4)
    return n.select("article_id", "expected", "actual", "shared", share("actual").alias("precision"), share("expected").alias("recall"))
