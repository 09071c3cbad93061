"""Where queries and their DuckDB SQL are registered, with the views that the SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threatloom.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ARTICLES = """articles AS (SELECT doc_id AS article_id, source, lang, substr(split_part(text, chr(10), 1), 1, 60) AS title, text AS content,
    TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS discovered_at FROM documents)"""
CHECKS = """checks AS (SELECT event_id AS check_id, user_id AS source_id, ts AS check_time, event_type <> 'error' AS success,
    event_type AS method, value AS response_time FROM events)"""
EXECUTIONS = """executions AS (SELECT o_orderkey AS execution_id, o_custkey AS article_id, o_orderstatus AS status, o_orderdate AS created_at,
    o_totalprice AS ranking_score, o_orderpriority AS step FROM orders)"""
#: The day that reports over articles look back from.
AS_OF = "2024-02-01 00:00:00"


def keyword_sql(word: str, column: str = "content") -> str:
    """Whether a keyword of the report registry stands in the column by its rule, in DuckDB SQL."""
    edge = r"[^\p{L}\p{N}_]"
    if word in T.SYMBOLS:
        return f"contains({column}, '{word}')"
    first = "[a-zA-Z0-9_]" if word.startswith(".") else f"(^|{edge})"
    plain = word.replace(".", r"\.")
    return f"(contains(lower({column}), '{word}') AND regexp_matches(lower({column}), '{first}{plain}($|{edge})'))"


def count_sql(words: list[str], column: str = "content") -> str:
    return " + ".join(f"CAST({keyword_sql(w, column)} AS INTEGER)" for w in words)


def score_sql(column: str = "content") -> str:
    """The keyword score over the report registry, in DuckDB SQL."""
    parts = [f"{T.TIER_WEIGHTS[tier]} * (1 - pow(0.5, {count_sql(words, column)}))" for tier, words in T.KEYWORDS.items()]
    return f"round(greatest(0.0, least(99.9, CAST(coalesce({' + '.join(parts)}, 0) AS DOUBLE))), 1)"


def mean_sql(value: str, scale: int, digits: int = 2) -> str:
    """The same mean as reports.exact_mean, in DuckDB SQL."""
    return f"floor(CAST(sum(CAST(round({value} * {scale}) AS BIGINT)) AS BIGINT) / count({value}) / {scale} * {10**digits} + 0.5) / {10.0**digits}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register
