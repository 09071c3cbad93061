"""Dashboard queries, and the table changes that sweeps make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from threatloom.functions import text as T
from threatloom.operators import summaries as S
from threatloom.operators.reports import exact_mean
from threatloom.plans.registry import ARTICLES, AS_OF, CHECKS, EXECUTIONS, count_sql, keyword_sql, mean_sql, query, score_sql
from threatloom.views import annotations, articles, checks, executions, table

_hs = lambda: T.hunt_score(F.col("content"))
_SCORED = f"{ARTICLES}, s AS (SELECT *, {score_sql()} AS hs FROM articles)"
_ANY = lambda tier: reduce(lambda a, b: a | b, T.hits(F.col("content"), T.KEYWORDS[tier]))
_ANY_SQL = lambda tier: "(" + " OR ".join(keyword_sql(w) for w in T.KEYWORDS[tier]) + ")"


@query("score_histogram", f"WITH {_SCORED} SELECT CASE WHEN hs IS NULL THEN 'Null' WHEN hs = 0 THEN '0' WHEN hs >= 0.1 AND hs <= 10 THEN '1-10' WHEN hs >= 10.1 AND hs <= 25 THEN '11-25' WHEN hs >= 25.1 AND hs <= 50 THEN '26-50' WHEN hs >= 50.1 AND hs <= 75 THEN '51-75' WHEN hs >= 75.1 AND hs <= 90 THEN '76-90' WHEN hs >= 90.1 AND hs <= 99 THEN '91-99' WHEN hs >= 99.1 AND hs <= 100 THEN '99-100' ELSE 'Unknown' END AS bucket, count(*) AS n FROM s GROUP BY 1")
def score_histogram(spark, sf):
    a = articles(spark, sf).select(_hs().alias("hs"))
    return S.score_histogram(a, F.col("hs"))


@query("score_overview", f"WITH {_SCORED} SELECT {mean_sql('CASE WHEN hs > 0 THEN hs END', 10)} AS avg_score, count(*) FILTER (WHERE hs > 50) AS above_50, count(*) FILTER (WHERE {_ANY_SQL('perfect')}) AS with_perfect, count(*) FILTER (WHERE {_ANY_SQL('lolbas')}) AS with_lolbas FROM s")
def score_overview(spark, sf):
    return S.score_overview(articles(spark, sf), _hs(), _ANY("perfect"), _ANY("lolbas"))


@query("score_trend", f"WITH {_SCORED} SELECT CAST(discovered_at AS DATE) AS day, {mean_sql('CASE WHEN hs > 0 THEN hs END', 10)} AS avg_score, count(*) AS n FROM s GROUP BY 1")
def score_trend(spark, sf):
    return S.score_trend(articles(spark, sf), _hs())


@query("top_sources_by_score", f"WITH {_SCORED} SELECT source, {mean_sql('CASE WHEN hs > 0 THEN hs END', 10)} AS avg_score FROM s GROUP BY 1 ORDER BY avg_score DESC NULLS LAST, source LIMIT 8")
def top_sources_by_score(spark, sf):
    """The eight best sources: a top-k report."""
    rows = articles(spark, sf).select("source", _hs().alias("hs")).groupBy("source")
    return rows.agg(exact_mean(F.when(F.col("hs") > 0, F.col("hs")), 10).alias("avg_score")).orderBy(F.desc_nulls_last("avg_score"), "source").limit(8)


@query("source_article_stats", f"WITH {ARTICLES} SELECT source, count(*) AS n, {mean_sql('CAST(length(content) AS DOUBLE)', 1)} AS avg_length, count(DISTINCT CAST(discovered_at AS DATE)) AS days FROM articles GROUP BY 1")
def source_article_stats(spark, sf):
    return S.per_source(articles(spark, sf))


@query("embedding_coverage", f"WITH {ARTICLES}, v AS (SELECT DISTINCT vec_id FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT source, count(*) AS total, count(vec_id) AS embedded FROM articles LEFT JOIN v ON vec_id = article_id GROUP BY 1) SELECT *, round(embedded * 100.0 / total, 2) AS percent FROM c")
def embedding_coverage(spark, sf):
    return S.coverage(articles(spark, sf), table(spark, sf, "embeddings"))


@query("annotation_stats", "WITH a AS (SELECT CASE WHEN quality = 1 THEN 'relevant' ELSE 'not_relevant' END AS annotation_type, toxic FROM labels) SELECT annotation_type, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS toxic, round(count(*) * 100.0 / (SELECT count(*) FROM a), 2) AS percent FROM a GROUP BY 1")
def annotation_stats(spark, sf):
    return S.annotation_stats(annotations(spark, sf))


@query("ingestion_health", f"""WITH {CHECKS}, l AS (SELECT source_id, arg_max(success, (check_time, check_id)) AS ok, count(*) FILTER (WHERE NOT success) AS failed FROM checks GROUP BY 1),
    s AS (SELECT CASE WHEN NOT ok THEN 'critical' WHEN failed > 0 THEN 'warning' ELSE 'healthy' END AS st FROM l),
    c AS (SELECT count(*) FILTER (WHERE st = 'healthy') AS healthy, count(*) FILTER (WHERE st = 'warning') AS warning, count(*) FILTER (WHERE st = 'critical') AS critical, count(*) AS monitored FROM s),
    u AS (SELECT *, round(CAST((healthy + 0.5 * warning) * 100 AS DOUBLE) / monitored, 2) AS uptime FROM c) SELECT *, CASE WHEN critical >= greatest(3, ceil(monitored * 0.2)) THEN 'critical' WHEN uptime >= 90 THEN 'nominal' ELSE 'degraded' END AS state FROM u""")
def ingestion_health(spark, sf):
    return S.ingestion_health(checks(spark, sf))


@query("dashboard_series", f"WITH {ARTICLES}, d AS (SELECT CAST(DATE '2023-12-28' + CAST(unnest(range(20)) AS INTEGER) AS DATE) AS day), c AS (SELECT CAST(discovered_at AS DATE) AS day, count(*) AS c FROM articles GROUP BY 1) SELECT day, CAST(coalesce(c, 0) AS BIGINT) AS n FROM d LEFT JOIN c USING (day)")
def dashboard_series(spark, sf):
    return S.series(articles(spark, sf), "2023-12-28", 20)


@query("errors_by_version", "SELECT l_shipmode_class AS version, count(*) AS n, round(sum(abs(e)) / count(e), 4) AS mae, round(sum(e * e) / count(e), 4) AS mse, count(*) FILTER (WHERE e = 0) AS exact, count(*) FILTER (WHERE abs(e) BETWEEN 1 AND 2) AS within_two, count(*) FILTER (WHERE abs(e) > 2) AS beyond FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_class, CAST(l_quantity AS BIGINT) % 7 - l_linenumber AS e FROM lineitem) GROUP BY 1")
def errors_by_version(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("version", F.concat("l_returnflag", "l_linestatus"))
    return S.errors_by_version(rows, "version", F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long") % 7)


@query("usage_counts", "SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS used, count(*) FILTER (WHERE NOT value > 50) AS unused FROM events GROUP BY 1")
def usage_counts(spark, sf):
    return S.usage_counts(table(spark, sf, "events"), "event_type", F.col("value") > 50)


@query("execution_overview", f"WITH {EXECUTIONS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'O') AS open, count(*) FILTER (WHERE status = 'F') AS finished, count(*) FILTER (WHERE status = 'P') AS pending, count(DISTINCT article_id) AS articles FROM executions")
def execution_overview(spark, sf):
    s = F.col("status")
    return executions(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("finished"), F.count_if(s == "P").alias("pending"), F.countDistinct("article_id").alias("articles"))


@query("keyword_counts", f"WITH {ARTICLES} SELECT count(*) AS articles, " + ", ".join(f"CAST(sum({count_sql(ws)}) AS BIGINT) AS {tier}" for tier, ws in T.KEYWORDS.items()) + " FROM articles")
def keyword_counts(spark, sf):
    counts = [reduce(lambda a, b: a + b, (h.cast("int") for h in T.hits(F.col("content"), ws))).alias(tier) for tier, ws in T.KEYWORDS.items()]
    return articles(spark, sf).select(*counts).agg(F.count(F.lit(1)).alias("articles"), *(F.sum(t).alias(t) for t in T.KEYWORDS))


@query("executions_with_titles", f"WITH {ARTICLES}, {EXECUTIONS} SELECT execution_id, article_id, status, title, source FROM executions JOIN articles USING (article_id)")
def executions_with_titles(spark, sf):
    parents = articles(spark, sf).select("article_id", "title", "source")
    return executions(spark, sf).select("execution_id", "article_id", "status").join(parents, "article_id")


@query("annotated_sources", f"WITH {ARTICLES} SELECT source, lang, quality, count(*) AS n FROM labels JOIN articles ON doc_id = article_id JOIN embeddings ON vec_id = article_id GROUP BY 1, 2, 3")
def annotated_sources(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("article_id"))
    joined = annotations(spark, sf).join(articles(spark, sf).select("article_id", "source", "lang"), "article_id").join(vectors, "article_id")
    return joined.groupBy("source", "lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("merged_sources", "WITH e AS (SELECT page_id, regexp_replace(url, '/+$', '') AS k, url, 0 AS s FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, regexp_replace(url, '/+$', ''), url, 1 FROM pages) SELECT DISTINCT ON (k) page_id, url FROM e ORDER BY k, s, page_id, url")
def merged_sources(spark, sf):
    """Pages whose id isn't divisible by 3 are the first of two sources, all pages the second."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return S.merged_first(p.where("page_id % 3 <> 0"), p, key="url")


@query("insert_missing", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 4 <> 0")
def insert_missing(spark, sf):
    """A stored table of every fourth customer takes in all that it lacks."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return S.insert_missing(c.where("id % 4 = 0"), c.withColumn("name", F.upper("name")), "id")


@query("upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer")
def upsert(spark, sf):
    """Stored: customers with odd ids or ids divisible by 4; the new rows, with even ids, change the name and not the balance of stored ones."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = c.where("id % 2 = 0").select("id", F.upper("name").alias("name"), F.lit(0.0).alias("balance"))
    return S.upsert(c.where("id % 2 <> 0 OR id % 4 = 0"), new, "id", ["name"])


@query("retention", f"WITH {CHECKS} SELECT check_id, source_id FROM checks WHERE check_time >= TIMESTAMP '{AS_OF}' - INTERVAL 12 DAY")
def retention(spark, sf):
    return S.retained(checks(spark, sf), "check_time", AS_OF, 12).select("check_id", "source_id")


@query("cascade_delete", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return S.cascade_delete(table(spark, sf, "events").select("event_id", "user_id"), gone, "user_id")
