"""Queries that work off a table as a stream."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.plans.registry import ARTICLES, CHECKS, query
from threatloom.session import shared_folder
from threatloom.streaming import sinks, sweeps
from threatloom.views import articles, table


def _checks(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("check_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("check_time"),
        (F.col("event_type") != "error").alias("success"), F.col("value").alias("response_time"),
    )


@query("stream_bucket_counts", f"WITH {CHECKS} SELECT time_bucket(INTERVAL 1 DAY, check_time) AS start, count(*) AS n, count(*) FILTER (WHERE NOT success) AS failed FROM checks GROUP BY 1")
def stream_bucket_counts(spark, sf):
    found = sweeps.run(spark, f"{sf}/events.parquet", _checks, lambda c: sweeps.bucket_counts(c, width="1 day", late="400 days"), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "failed")


@query("stream_first_seen", "SELECT user_id AS source_id, count(DISTINCT event_type) AS methods FROM events GROUP BY 1")
def stream_first_seen(spark, sf):
    """One row of each pair of source and method passes; counted by source."""
    found = sweeps.run(spark, f"{sf}/events.parquet", lambda e: e.withColumn("ts", F.col("ts").cast("timestamp")), lambda e: sweeps.first_seen(e, ["user_id", "event_type"], "ts", late="400 days"), "append")
    return found.groupBy(F.col("user_id").alias("source_id")).agg(F.count(F.lit(1)).alias("methods"))


@query("stream_source_health", f"""WITH {CHECKS}, r AS (SELECT source_id, success, sum(CAST(success AS INTEGER)) OVER (PARTITION BY source_id ORDER BY check_time, check_id) AS run FROM checks),
    m AS (SELECT source_id, max(run) AS run, count(*) AS checks FROM r GROUP BY 1) SELECT m.source_id, m.checks, count(r.run) AS failures FROM m LEFT JOIN r ON m.source_id = r.source_id AND m.run = r.run AND NOT r.success GROUP BY 1, 2""")
def stream_source_health(spark, sf):
    found = sweeps.run(spark, f"{sf}/events.parquet", _checks, sweeps.source_health, "update")
    return found.groupBy("source_id").agg(F.max(F.struct("checks", "failures")).alias("r")).select("source_id", "r.checks", "r.failures")


@query("stream_retained_checks", f"""WITH {CHECKS}, d AS (SELECT source_id, CAST(check_time AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE NOT success) AS failed FROM checks GROUP BY 1, 2),
    k AS (SELECT d.*, day + INTERVAL 11 DAY > (SELECT max(check_time) - INTERVAL 2 DAY FROM checks) AS kept FROM d)
    SELECT source_id, CAST(count(*) FILTER (WHERE kept) AS INTEGER) AS days, min(day) FILTER (WHERE kept) AS oldest, CAST(coalesce(sum(n) FILTER (WHERE kept), 0) AS BIGINT) AS checks, CAST(coalesce(sum(failed) FILTER (WHERE kept), 0) AS BIGINT) AS failures FROM k GROUP BY 1""")
def stream_retained_checks(spark, sf):
    """Days leave the state ten days after their end, by the watermark of two days behind the newest check; the last row of each source."""
    found = sweeps.run(spark, f"{sf}/events.parquet", _checks, lambda c: sweeps.retained_checks(c, lookback="2 days", keep_days=10), "update")
    return found.groupBy("source_id").agg(F.min_by(F.struct("days", "oldest", "checks", "failures"), "days").alias("r")).select("source_id", "r.*")


@query("insert_conflicts", f"""WITH {ARTICLES}, h AS (SELECT article_id, sha256(coalesce(content, '')) AS h, article_id IN (SELECT doc_id FROM labels) AS early FROM articles),
    a AS (SELECT h, min(article_id) AS id FROM h WHERE early GROUP BY 1), b AS (SELECT h, min(article_id) AS id FROM h WHERE h NOT IN (SELECT h FROM a) GROUP BY 1)
    SELECT article_id, CAST(0 AS INTEGER) AS batch, CASE WHEN article_id = id THEN 'added' ELSE 'conflict' END AS outcome, id AS existing_id FROM h JOIN a USING (h) WHERE early
    UNION ALL SELECT article_id, 1, CASE WHEN article_id = b.id THEN 'added' ELSE 'conflict' END, coalesce(a.id, b.id) FROM h LEFT JOIN a USING (h) LEFT JOIN b USING (h)""")
def insert_conflicts(spark, sf):
    """Labelled articles are inserted first, then all articles; the second batch comes twice."""
    folder = f"{shared_folder(spark)}/inserts-{uuid4().hex}"
    every = articles(spark, sf).select("article_id", "title", "content")
    early = every.join(table(spark, sf, "labels").select(F.col("doc_id").alias("article_id")), "article_id", "left_semi")
    for batch, rows in ((0, early), (1, every), (1, every)):
        sinks.insert(spark, folder, rows, batch)
    added = sinks.stored(spark, folder, "articles").select("article_id", "batch", F.lit("added").alias("outcome"), F.col("article_id").alias("existing_id"))
    return added.unionByName(sinks.stored(spark, folder, "conflicts").select("article_id", "batch", F.lit("conflict").alias("outcome"), "existing_id"))


@query("upserted_matches", """WITH m AS (SELECT l_orderkey % 1000 AS article_id, l_suppkey % 10 AS rule_id, CASE WHEN l_linenumber % 2 = 0 THEN 'chunk' ELSE 'article' END AS match_level, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS chunk_id,
        l_discount AS similarity, l_linestatus AS status, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS batch FROM lineitem),
    b AS (SELECT article_id, rule_id, match_level, chunk_id, batch, max(similarity) AS similarity, max((similarity, status)) AS top FROM m GROUP BY ALL)
    SELECT article_id, rule_id, match_level, CAST(chunk_id AS BIGINT) AS chunk_id, arg_max(similarity, batch) AS similarity, CAST(min(batch) AS INTEGER) AS created_in, CAST(max(batch) AS INTEGER) AS updated_in FROM b GROUP BY ALL""")
def upserted_matches(spark, sf):
    """Three batches of matches, by return flag; times are days, one for each batch."""
    folder = f"{shared_folder(spark)}/matches-{uuid4().hex}"
    chunk = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).cast("long")
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 1000).alias("article_id"), (F.col("l_suppkey") % 10).alias("rule_id"), F.when(chunk.isNull(), "article").otherwise("chunk").alias("match_level"), chunk.alias("chunk_id"),
        F.col("l_discount").alias("similarity"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"),
    )
    for batch, flag in enumerate("ANR"):
        sinks.upsert_matches(spark, folder, rows.where(F.col("flag") == flag).drop("flag"), batch, F.expr(f"DATE'2024-01-01' + {batch}"))
    day = lambda c: F.date_diff(F.col(c), F.lit("2024-01-01").cast("date"))
    return sinks.matches(spark, folder).select("article_id", "rule_id", "match_level", "chunk_id", "similarity", day("created_at").alias("created_in"), day("updated_at").alias("updated_in"))
