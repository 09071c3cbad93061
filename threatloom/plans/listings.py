"""Queries over article lists: filters, paging, lookups and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions import text as T
from threatloom.operators import listings, search
from threatloom.plans.registry import ARTICLES, AS_OF, CHECKS, EXECUTIONS, query, score_sql
from threatloom.views import annotations, articles, checks, executions, table


@query("article_filter", f"WITH {ARTICLES} SELECT article_id, source, title, length(content) AS char_length FROM articles WHERE lang = 'en' AND discovered_at >= TIMESTAMP '2024-01-03' AND discovered_at <= TIMESTAMP '2024-01-20' AND contains(content, 'the')")
def article_filter(spark, sf):
    found = listings.article_filter(articles(spark, sf).where("lang = 'en'"), after="2024-01-03", before="2024-01-20", contains="the", load_content=False)
    return found.select("article_id", "source", "title", "char_length")


@query("article_page", f"WITH {ARTICLES} SELECT article_id, source, title FROM articles ORDER BY title ASC NULLS LAST, article_id DESC LIMIT 20 OFFSET 40")
def article_page(spark, sf):
    """The third page of a list of twenty: paging is the feature."""
    return listings.article_filter(articles(spark, sf).drop("content"), sort_by="title", descending=False, offset=40, limit=20).select("article_id", "source", "title")


@query("article_count", f"WITH {ARTICLES} SELECT source, lang, count(*) AS n FROM articles GROUP BY 1, 2")
def article_count(spark, sf):
    return articles(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("article_lookup", f"WITH {ARTICLES} SELECT article_id, title FROM articles WHERE article_id IN (1, 5, 77, 190)")
def article_lookup(spark, sf):
    return listings.lookup(articles(spark, sf), [1, 5, 77, 190]).select("article_id", "title")


@query("distinct_sources", f"WITH {ARTICLES} SELECT DISTINCT source, lang FROM articles WHERE source NOT IN ('manual', 'eval_articles')")
def distinct_sources(spark, sf):
    return articles(spark, sf).where(~F.col("source").isin("manual", "eval_articles")).select("source", "lang").distinct()


@query("unlabelled_articles", f"WITH {ARTICLES} SELECT article_id, discovered_at FROM articles WHERE article_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_articles(spark, sf):
    return listings.without(articles(spark, sf).select("article_id", "discovered_at"), annotations(spark, sf))


@query("labelled_articles", f"WITH {ARTICLES} SELECT article_id, source FROM articles WHERE article_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labelled_articles(spark, sf):
    return listings.within(articles(spark, sf).select("article_id", "source"), annotations(spark, sf).where("quality = 1"))


@query("missing_vectors", "SELECT doc_id AS article_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)")
def missing_vectors(spark, sf):
    stored = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("article_id"))
    return listings.without(articles(spark, sf).select("article_id"), stored)


@query("corruption_scan", "SELECT count(*) AS scanned, count(*) FILTER (WHERE contains(text, chr(65533))) AS corrupt, min(doc_id) FILTER (WHERE contains(text, chr(65533))) AS first_id FROM documents")
def corruption_scan(spark, sf):
    bad = F.contains("content", F.lit("�"))
    return articles(spark, sf).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(bad).alias("corrupt"), F.min(F.when(bad, F.col("article_id"))).alias("first_id"))


@query("flag_distinct", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events WHERE (props ->> '$.k') IS DISTINCT FROM '7'")
def flag_distinct(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").where(~k.eqNullSafe("7")).select("event_id", k.cast("int").alias("k"))


@query("json_sort", "SELECT event_id, CAST(coalesce(props ->> '$.k', '0') AS DOUBLE) AS k FROM events ORDER BY k DESC, event_id LIMIT 25")
def json_sort(spark, sf):
    """The largest twenty-five by a number inside JSON: a top-k report."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).cast("double")
    return table(spark, sf, "events").select("event_id", k.alias("k")).orderBy(F.desc("k"), "event_id").limit(25)


@query("rule_queue_page", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%re%' AND p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 10")
def rule_queue_page(spark, sf):
    found = table(spark, sf, "part").where(F.ilike("p_name", F.lit("%re%")) & (F.col("p_size") > 10))
    return found.orderBy(F.desc("p_retailprice"), "p_partkey").offset(10).limit(50).select("p_partkey", "p_name", "p_type")


@query("article_neighbours", f"WITH {ARTICLES} SELECT article_id, lag(article_id) OVER (ORDER BY article_id) AS previous_id, lead(article_id) OVER (ORDER BY article_id) AS next_id FROM articles")
def article_neighbours(spark, sf):
    a = articles(spark, sf)
    return listings.neighbours(a, a)


@query("search_with_score", f"""WITH {ARTICLES}, s AS (SELECT article_id, lower(title) AS t, lower(content) AS c, {score_sql()} AS hs, discovered_at FROM articles WHERE lang = 'en')
    SELECT article_id, hs AS hunt_score FROM s WHERE hs >= 5 AND (contains(t, 'version') OR contains(c, 'version') OR contains(t, 'token') OR contains(c, 'token'))""")
def search_with_score(spark, sf):
    found = search.boolean_search(articles(spark, sf).where("lang = 'en'"), "version token")
    return found.select("article_id", T.hunt_score(F.col("content")).alias("hunt_score")).where("hunt_score >= 5")


_BAD = " OR ".join([*(f"contains(c, {'chr(65533)' if t == chr(65533) else chr(39) + t + chr(39)})" for t in T.GARBAGE_TEXTS), *(f"contains(lower(c), '{p}')" for p in T.GARBAGE_PHRASES)])
_RUNS = "|".join(p.replace(r"\w", r"\p{L}\p{N}").replace(r"\x7F-\xFF", r"\x{7F}-\x{FF}") for p in T.GARBAGE_RUNS).replace("'", "''")
_TRIM = lambda x: rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


@query("article_issues", rf"""WITH {ARTICLES}, a AS (SELECT article_id, {_TRIM("title")} AS t, coalesce(content, '') AS c, {_TRIM("content")} AS x FROM articles)
    SELECT article_id, array_to_string(list_filter([CASE WHEN t = '' THEN 'missing_title' END, CASE WHEN t <> '' AND length(t) < 5 THEN 'short_title' END, CASE WHEN length(t) > 500 THEN 'long_title' END, CASE WHEN x = '' THEN 'missing_content' END,
    CASE WHEN x <> '' AND (length(regexp_replace(c, '[^\[\]{{}}|\\]', '', 'g')) / nullif(length(c), 0) > 0.15 OR regexp_matches(c, '{_RUNS}') OR {_BAD}) THEN 'garbage' END,
    CASE WHEN x <> '' AND ({" OR ".join(f"contains(lower(c), '{p}')" for p in T.FAILURE_PHRASES)}) THEN 'extraction_failed' END, CASE WHEN x <> '' AND regexp_matches(c, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'control_characters' END,
    CASE WHEN x <> '' AND contains(c, chr(65533)) THEN 'broken_characters' END, CASE WHEN x <> '' AND length(x) < 200 THEN 'short_content' END], lambda x: x IS NOT NULL), ',') AS issues FROM a""")
def article_issues(spark, sf):
    return listings.issues(articles(spark, sf))


@query("article_gate", f"""WITH {ARTICLES}, a AS (SELECT *, least(1.0, length(content) / 2000.0) AS q, length(content) / 4 * 0.00001 AS cost FROM articles)
    SELECT article_id, CASE WHEN length(title) < 10 THEN 'title_too_short' WHEN length(title) > 200 THEN 'title_too_long' WHEN length(content) < 100 THEN 'content_too_short' WHEN length(content) > 50000 THEN 'content_too_long'
    WHEN date_diff('day', discovered_at, TIMESTAMP '2025-01-05') > 365 THEN 'too_old' WHEN q < 0.5 THEN 'low_quality' WHEN cost > 0.1 THEN 'too_costly' ELSE 'ok' END AS reason FROM a""")
def article_gate(spark, sf):
    n = F.length("content")
    return listings.article_gate(articles(spark, sf), as_of="2025-01-05", quality=F.least(F.lit(1.0), n / 2000.0), cost=n / 4 * 0.00001)


@query("url_scope", "SELECT page_id, (contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), 'example') OR contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '.org')) AND regexp_matches(url, '^(?:https?://[^/]+/[a-z]+)') AS in_scope FROM pages")
def url_scope(spark, sf):
    return listings.url_scope(table(spark, sf, "pages"), ["example", ".org"], [r"https?://[^/]+/[a-z]+"])


@query("due_sources", f"WITH {CHECKS}, l AS (SELECT source_id, max(check_time) AS last_check FROM checks GROUP BY 1) SELECT source_id, last_check FROM l WHERE epoch(TIMESTAMP '2024-01-31') - epoch(last_check) >= 3600")
def due_sources(spark, sf):
    return listings.due_sources(checks(spark, sf), as_of="2024-01-31", frequency_seconds=3600)


@query("workflow_eligibility", f"""WITH {ARTICLES}, {EXECUTIONS}, s AS (SELECT article_id, count(*) FILTER (WHERE status IN ('O', 'P')) AS o, count(*) FILTER (WHERE status = 'F') AS f FROM executions GROUP BY 1)
    SELECT a.article_id, CASE WHEN {score_sql()} <= 3 THEN 'below_threshold' WHEN coalesce(o, 0) > 0 THEN 'running' WHEN coalesce(f, 0) > 0 THEN 'done' ELSE 'ok' END AS verdict FROM articles a LEFT JOIN s USING (article_id)""")
def workflow_eligibility(spark, sf):
    return listings.eligible(articles(spark, sf), executions(spark, sf), T.hunt_score(F.col("content")), threshold=3)


_CUES = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind}'" for kind, words in listings.TYPE_CUES.items())


@query("content_type", f"WITH {ARTICLES}, a AS (SELECT article_id, lower(coalesce(title, '')) AS t FROM articles) SELECT article_id, CASE {_CUES} ELSE 'article' END AS content_type FROM a")
def content_type(spark, sf):
    return listings.content_type(articles(spark, sf))


@query("sql_validate", f"""WITH q AS (SELECT doc_id, upper(trim(text)) AS t FROM documents), p AS (SELECT conv_id AS doc_id, upper(trim(text)) AS t FROM conversations),
    a AS (SELECT * FROM q UNION ALL SELECT * FROM p) SELECT CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '\\b({"|".join(search.FORBIDDEN)})\\b') THEN 'forbidden_word'
    WHEN regexp_matches(t, '(?i){"|".join(search.DANGEROUS)}') THEN 'dangerous_pattern' WHEN NOT starts_with(t, 'SELECT') THEN 'not_select' ELSE 'ok' END AS verdict, count(*) AS n FROM a GROUP BY 1""")
def sql_validate(spark, sf):
    every = table(spark, sf, "documents").select("text").unionByName(table(spark, sf, "conversations").select("text"))
    return every.groupBy(search.sql_verdict(F.col("text")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("recent_breakdown", f"""WITH {ARTICLES}, s AS (SELECT source, {score_sql()} AS hs FROM articles WHERE discovered_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)
    SELECT source, count(*) AS n, count(*) FILTER (WHERE hs > 0) AS scored FROM s GROUP BY 1 ORDER BY n DESC, source LIMIT 10""")
def recent_breakdown(spark, sf):
    """The ten sources with most articles of the last days: a top-k report."""
    recent = articles(spark, sf).where(F.col("discovered_at") >= F.expr(f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 30 DAY"))
    rows = recent.select("source", T.hunt_score(F.col("content")).alias("hs")).groupBy("source")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hs") > 0).alias("scored")).orderBy(F.desc("n"), "source").limit(10)
