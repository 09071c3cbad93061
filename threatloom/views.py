"""The tables that the operators read, as views with the columns of articles, annotations, checks and executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: the title is the first line, cut to 60 characters; one article an hour from 2024 on."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.col("source"),
        F.col("lang"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.expr("TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, doc_id)").alias("discovered_at"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as annotations: quality 1 is relevant, 0 is not."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("article_id"),
        F.when(F.col("quality") == 1, "relevant").otherwise("not_relevant").alias("annotation_type"),
        "quality",
        "toxic",
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as source checks: an error event is a failed check, value is its response time."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("check_id"),
        F.col("user_id").alias("source_id"),
        F.col("ts").alias("check_time"),
        (F.col("event_type") != "error").alias("success"),
        F.col("event_type").alias("method"),
        F.col("value").alias("response_time"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as workflow executions."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("execution_id"),
        F.col("o_custkey").alias("article_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("ranking_score"),
        F.col("o_orderpriority").alias("step"),
    )


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """A rounded percentage; 0 where there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))
