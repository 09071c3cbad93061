"""Queries over behaviours and coverage: benchmark items are rules, their longer words patterns; an article's longer words are behaviours."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions import text as T
from threatloom.operators import chunks
from threatloom.operators import coverage as C
from threatloom.plans.registry import ARTICLES, keyword_sql, query, score_sql
from threatloom.plans.retrieval import NEAR, rule_hits
from threatloom.views import articles, table

_TIERS = [t for t in T.KEYWORDS if t != "negative"]
_WORD = r"[^ \t\r\n\f\v]+"
_BEHAVIOURS = rf"b AS (SELECT DISTINCT article_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}]{{6,}}')) AS behaviour FROM articles)"
_PATTERNS = rf"p AS (SELECT DISTINCT item_id AS rule_id, unnest(list_filter(regexp_extract_all(lower(text), '{_WORD}'), lambda w: length(w) > 4)) AS pattern FROM benchmark)"
_RELATED = f"{ARTICLES}, {_BEHAVIOURS}, {_PATTERNS}, bs AS (SELECT DISTINCT behaviour FROM b), ps AS (SELECT DISTINCT pattern FROM p), x AS (SELECT behaviour, pattern FROM bs, ps WHERE contains(behaviour, pattern) OR contains(pattern, behaviour))"
_CHUNKS = f"""{ARTICLES}, cs AS (SELECT article_id, content AS whole, CAST(unnest(range(0, greatest(length(content) - 200, 1), 800)) AS INTEGER) AS start FROM articles WHERE length(content) > 0),
    c AS (SELECT article_id, substr(whole, start + 1, 1000) AS content FROM cs)"""


def _behaviours(spark, sf):
    return articles(spark, sf).select("article_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"\p{L}{6,}"), F.lit(0)))).alias("behaviour"))


def _patterns(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("rule_id"), F.explode(C.title_patterns(F.col("text"))).alias("pattern"))


@query("behaviour_pattern_pairs", f"WITH {_RELATED} SELECT * FROM x")
def behaviour_pattern_pairs(spark, sf):
    return C.related(_behaviours(spark, sf), _patterns(spark, sf))


@query("article_behaviours", f"""WITH {_CHUNKS}, s AS (SELECT article_id, {score_sql()} AS hs, {", ".join(f"[{', '.join(f'CASE WHEN {keyword_sql(w)} THEN {chr(39)}{w}{chr(39)} END' for w in T.KEYWORDS[t])}] AS {t}" for t in _TIERS)} FROM c)
    SELECT article_id, {", ".join(f"array_to_string(list_sort(list_distinct(flatten(list({t})))), ',') AS {t}" for t in _TIERS)}, count(*) AS chunks,
    round(CAST(sum(CAST(round(hs * 10) AS BIGINT)) AS BIGINT) / count(hs) / 10, 6) AS mean_score, max(hs) AS largest_score FROM s GROUP BY 1""")
def article_behaviours(spark, sf):
    found = C.article_behaviours(chunks.fixed_chunks(articles(spark, sf)))
    return found.select("article_id", *(F.array_join(t, ",").alias(t) for t in _TIERS), "chunks", F.round("mean_score", 6).alias("mean_score"), "largest_score")


@query("rule_coverage", f"""WITH {_RELATED}, {NEAR}, n AS (SELECT article_id, count(*) AS behaviours FROM b GROUP BY 1), h AS (SELECT DISTINCT rule_id, behaviour FROM x JOIN p USING (pattern)),
    k2 AS (SELECT vec_id AS article_id, CAST(label AS BIGINT) AS rule_id, similarity FROM k WHERE round(similarity * 0.874, 6) >= 0.2),
    g AS (SELECT k2.article_id, k2.rule_id, count(*) AS matched FROM k2 JOIN b ON b.article_id = k2.article_id JOIN h ON h.rule_id = k2.rule_id AND h.behaviour = b.behaviour GROUP BY 1, 2),
    o AS (SELECT k2.article_id, k2.rule_id, similarity, CAST(coalesce(behaviours, 0) AS BIGINT) AS behaviours, CAST(coalesce(matched, 0) AS BIGINT) AS matched, coalesce(matched / behaviours, 0) AS overlap FROM k2 LEFT JOIN n USING (article_id) LEFT JOIN g ON g.article_id = k2.article_id AND g.rule_id = k2.rule_id),
    v AS (SELECT *, CASE WHEN similarity >= 0.85 AND overlap >= 0.7 THEN 'covered' WHEN similarity >= 0.7 AND overlap >= 0.3 THEN 'extend' ELSE 'new' END AS status FROM o)
    SELECT article_id, rule_id, similarity, behaviours, matched, round(overlap, 6) AS overlap, status, round(CASE status WHEN 'covered' THEN least(0.9, (similarity + overlap) / 2) WHEN 'extend' THEN (similarity + overlap) / 2 ELSE 1 - (similarity + overlap) / 2 END, 8) AS confidence FROM v""")
def rule_coverage(spark, sf):
    hits = rule_hits(spark, sf).where(F.round(F.col("similarity") * 0.874, 6) >= 0.2)
    found = hits.select(F.col("vec_id").alias("article_id"), F.col("rule").cast("long").alias("rule_id"), "similarity")
    status, sure = C.verdict(F.col("similarity"), F.col("overlap"))
    return C.overlaps(found, _behaviours(spark, sf), _patterns(spark, sf)).select("article_id", "rule_id", "similarity", "behaviours", "matched", F.round("overlap", 6).alias("overlap"), status.alias("status"), F.round(sure, 8).alias("confidence"))
