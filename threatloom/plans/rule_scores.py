"""Queries over single rules, observables and sources; parts are rules, their columns detection values."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions import sql
from threatloom.functions import text as T
from threatloom.operators import listings
from threatloom.operators import rule_scores as R
from threatloom.plans.registry import ARTICLES, query, score_sql
from threatloom.views import articles, table

_VALUES = """d AS (SELECT p_partkey AS rule_id, 'CommandLine' AS field, CASE p_size % 4 WHEN 0 THEN '*' || p_name || '*' WHEN 1 THEN '*ab*' WHEN 2 THEN p_name || ' --to 10.0.' || p_size || '.1' ELSE '*' END AS value, p_size % 3 = 0 AS in_list FROM part WHERE p_size % 5 <> 0
    UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Image' ELSE 'ParentImage' END, CASE WHEN p_size % 7 = 0 THEN 'c2.example.com' ELSE p_type END, false FROM part WHERE p_size % 11 <> 0)"""
_HUNT = f"""{_VALUES}, c AS (SELECT rule_id, count(*) FILTER (WHERE field = 'CommandLine') AS commands, count(*) FILTER (WHERE field = 'CommandLine' AND (NOT contains(value, '*') OR length(trim(replace(value, '*', ''))) > 10)) AS specific, bool_or(field = 'Image') AS image, bool_or(field = 'ParentImage') AS parent,
        sum(CASE WHEN trim(value) IN ('*', '.*') THEN 2 ELSE 0 END + CASE WHEN NOT in_list AND length(trim(replace(value, '*', ''))) < 3 THEN 1 ELSE 0 END) AS risks, sum(CASE WHEN regexp_matches(value, '\\b([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b') THEN 2 ELSE 0 END + CASE WHEN contains(value, 'example.com') THEN 1 ELSE 0 END) AS signs FROM d GROUP BY 1),
    r AS (SELECT p_partkey AS rule_id, CASE WHEN p_size % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN length(p_name || ' ' || repeat(p_type, 6)) > 50 THEN 0.1 ELSE 0 END + CASE WHEN p_brand = 'Brand#1' THEN 0.1 ELSE 0 END AS extra, CASE WHEN p_type = 'ECONOMY' THEN 'process_creation' WHEN p_type = 'SMALL' THEN 'file_event' END AS category, CASE WHEN p_size % 2 = 0 THEN 'windows' END AS product FROM part),
    s AS (SELECT r.rule_id, commands IS NOT NULL AS there, CASE WHEN commands = 0 THEN 0.3 ELSE specific / nullif(commands, 0) END AS a, least(1.0, 0.5 + extra) AS b, 0.5 + CASE WHEN image THEN 0.3 ELSE 0 END + CASE WHEN parent THEN 0.2 ELSE 0 END AS e,
        CASE WHEN category = 'process_creation' AND product = 'windows' THEN 1.0 WHEN category IS NOT NULL AND product IS NOT NULL THEN 0.7 WHEN category IS NOT NULL OR product IS NOT NULL THEN 0.5 ELSE 0.3 END AS f, CASE WHEN signs = 0 THEN 1.0 WHEN signs <= 1 THEN 0.8 WHEN signs <= 2 THEN 0.6 ELSE 0.3 END AS g,
        CASE WHEN commands IS NULL OR risks >= 3 THEN 'high' WHEN risks >= 1 THEN 'medium' ELSE 'low' END AS risk FROM r LEFT JOIN c USING (rule_id))"""


@query("huntability", f"""WITH {_HUNT} SELECT rule_id, CASE WHEN there THEN round(CAST(a * 0.25 + b * 0.2 + e * 0.15 + f * 0.15 + g * 0.25 AS DOUBLE) * 10, 6) ELSE 0.0 END AS score, risk AS false_positive_risk,
    CASE WHEN NOT there THEN 'No detection section' ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN a < 0.5 THEN 'Low command-line specificity' END, CASE WHEN f < 0.7 THEN 'Telemetry feasibility concerns' END, CASE WHEN risk = 'high' THEN 'High false-positive risk' END], lambda x: x IS NOT NULL), '; '), ''), 'Good coverage across all categories') END AS coverage_notes,
    CASE WHEN there THEN round(CAST(a AS DOUBLE) * 10, 6) END AS commandline_specificity, CASE WHEN there THEN round(CAST(b AS DOUBLE) * 10, 6) END AS ttp_clarity, CASE WHEN there THEN round(CAST(e AS DOUBLE) * 10, 6) END AS parent_child, CASE WHEN there THEN round(CAST(f AS DOUBLE) * 10, 6) END AS telemetry_feasibility, CASE WHEN there THEN round(CAST(g AS DOUBLE) * 10, 6) END AS overfitting FROM s""")
def huntability(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    command = F.when(size % 4 == 0, F.concat(F.lit("*"), "p_name", F.lit("*"))).when(size % 4 == 1, "*ab*").when(size % 4 == 2, F.concat("p_name", F.lit(" --to 10.0."), size.cast("string"), F.lit(".1"))).otherwise("*")
    values = p.where(size % 5 != 0).select(F.col("p_partkey").alias("rule_id"), F.lit("CommandLine").alias("field"), command.alias("value"), (size % 3 == 0).alias("in_list")).unionByName(
        p.where(size % 11 != 0).select(F.col("p_partkey").alias("rule_id"), F.when(size % 2 == 0, "Image").otherwise("ParentImage").alias("field"), F.when(size % 7 == 0, "c2.example.com").otherwise(F.col("p_type")).alias("value"), F.lit(False).alias("in_list"))
    )
    rules = p.select(
        F.col("p_partkey").alias("rule_id"), F.array(F.when(size % 3 == 0, "attack.t1059").otherwise("none")).alias("tags"), F.concat("p_name", F.lit(" "), F.repeat("p_type", 6), F.when(F.col("p_brand") == "Brand#1", " technique").otherwise("")).alias("d"),
        F.when(F.col("p_type") == "ECONOMY", "process_creation").when(F.col("p_type") == "SMALL", "file_event").alias("category"), F.when(size % 2 == 0, "windows").alias("product"), (F.col("p_brand") == "Brand#1").alias("t"),
    )
    # The hint at a technique isn't part of the length.
    length = F.length("d") - F.when(F.col("t"), F.length(F.lit(" technique"))).otherwise(0)
    described = rules.withColumn("description", F.when(length > 50, F.col("d")).when(F.col("t"), "a technique").otherwise("short"))
    return R.huntability(described, values)


@query("value_tokens", r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(url, '[*?|&<>"'']', ' ', 'g')), '[\s,;:/=]+'), lambda p: length(p) > 2))), ' ') AS tokens FROM pages""")
def value_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(R.value_tokens(F.col("url")), " ").alias("tokens"))


@query("observable_groups", """WITH o AS (SELECT user_id AS article_id, event_id AS idx, CASE event_id % 5 WHEN 0 THEN 'windows' WHEN 1 THEN 'macos' WHEN 2 THEN 'linux' WHEN 3 THEN 'cross-platform' ELSE 'unknown' END AS platform, event_type AS telemetry, CASE WHEN event_id % 7 <> 0 THEN 's' || (event_id % 3) END AS logsource FROM events)
    SELECT article_id, platform, telemetry, logsource, count(*) AS n, md5(string_agg(idx, ',' ORDER BY idx)) AS indices_md5, min(idx) AS first FROM o WHERE platform <> 'macos' AND logsource IS NOT NULL GROUP BY 1, 2, 3, 4""")
def observable_groups(spark, sf):
    e = F.col("event_id")
    platform = F.when(e % 5 == 0, " Win ").when(e % 5 == 1, "Mac OS X").when(e % 5 == 2, "LINUX").when(e % 5 == 3, "Platform-Agnostic").otherwise("beos")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("article_id"), e.alias("idx"), platform.alias("platform"), F.col("event_type").alias("telemetry"), F.when(e % 7 != 0, F.concat(F.lit("s"), (e % 3).cast("string"))).alias("logsource"))
    found = R.observable_groups(rows)
    return found.select("article_id", "platform", "telemetry", "logsource", "n", F.md5(F.array_join("original_indices", ",").cast("binary")).alias("indices_md5"), "first")


@query("source_metrics", f"""WITH {ARTICLES}, s AS (SELECT s_suppkey AS source_id, s_name AS name, s_nationkey % 2 = 0 AS active FROM supplier), a AS (SELECT article_id, article_id % (SELECT count(*) FROM supplier) AS source_id, {score_sql()} AS hs, quality FROM articles LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) ON doc_id = article_id)
    SELECT s.source_id, name, count(a.article_id) AS articles, coalesce(round(CAST(sum(CAST(round(hs * 10) AS BIGINT)) AS BIGINT) / count(hs) / 10, 6), 0.0) AS mean_score, count(quality) AS classified FROM s LEFT JOIN a USING (source_id) WHERE active GROUP BY 1, 2""")
def source_metrics(spark, sf):
    s = table(spark, sf, "supplier")
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("article_id")).agg(F.max("quality").alias("category"))
    rows = articles(spark, sf).select("article_id", (F.col("article_id") % s.count()).alias("source_id"), T.hunt_score(F.col("content")).alias("score")).join(labels, "article_id", "left")
    return R.source_metrics(s.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 2 == 0).alias("active")), rows)


@query("source_list", "SELECT DISTINCT s_suppkey AS identifier, s_name AS name FROM supplier WHERE s_nationkey % 2 = 0 AND contains(s_name, '1') ORDER BY name")
def source_list(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("identifier"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 2 == 0).alias("active"))
    return R.source_list(s, active=True, name="1").select("identifier", "name")


_PHRASES = ", ".join(f"'{p}'" for p in (*listings.TITLE_PHRASES, "tion", "que"))


@query("title_block", f"WITH {ARTICLES}, t AS (SELECT article_id, lower(coalesce(title, '')) AS t FROM articles), p AS (SELECT article_id, t, list_filter([{_PHRASES}], lambda x: contains(t, x)) AS f FROM t) SELECT article_id, t = '' OR len(f) > 0 AS blocked, f[1] AS phrase FROM p")
def title_block(spark, sf):
    return listings.title_blocked(articles(spark, sf), ("tion", "que"))


_THREATS = ", ".join(f"'{w}'" for w in listings.THREAT_WORDS)


_HEADINGS = ", ".join(rf"regexp_extract_all(c, '(?is)<h{n}\b[^>]*>(.*?)</h{n}>', 1)" for n in range(1, 7))


@query("enhanced_metadata", rf"""WITH a AS (SELECT page_id AS article_id, html AS c, TIMESTAMP '2024-01-01' + page_id * INTERVAL 31 HOUR AS p FROM pages),
    w AS (SELECT *, list_filter([{_THREATS}], lambda x: contains(lower(c), x)) AS ws, flatten([{_HEADINGS}]) AS hs FROM a)
    SELECT article_id, array_to_string(ws, ',') AS threat_words, CAST(len(ws) AS INTEGER) AS threat_word_count, strftime(p, '%A') AS day_of_week, strftime(p, '%B') AS month, CAST(year(p) AS INTEGER) AS year, CAST(floor(epoch(TIMESTAMP '2025-06-01' - p) / 86400) AS INTEGER) AS age_days,
    CAST(greatest(1, floor(len(regexp_extract_all(c, '[^ \t\r\n\f\v]+')) / 200)) AS INTEGER) AS reading_minutes, CAST(len(regexp_extract_all(c, '(?is)<img\b')) AS INTEGER) AS images, CAST(len(regexp_extract_all(c, '(?is)<a\b[^>]*\bhref\s*=')) AS INTEGER) AS links, array_to_string(list_transform(hs[1:10], lambda h: trim(regexp_replace(h, '<[^>]*>', '', 'g'))), '|') AS headings FROM w""")
def enhanced_metadata(spark, sf):
    """Pages as articles, published 31 hours apart."""
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("article_id"), F.col("html").alias("content"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, page_id * 31)").alias("published_at"))
    found = listings.enhanced(rows, as_of="2025-06-01 00:00:00")
    return found.withColumns({"threat_words": F.array_join("threat_words", ","), "headings": F.array_join("headings", "|")})


@query("sql_functions", r"""SELECT page_id, sha256(html) AS hash, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS domain, len(regexp_extract_all(html, '<a href=')) AS links, round(length(regexp_replace(html, '[^\[\]{}|\\]', '', 'g')) / length(html), 6) AS garbage FROM pages""")
def sql_functions(spark, sf):
    """The library's functions in SQL: hashes, hosts and links of every page."""
    sql.register(spark)
    return spark.sql(
        "SELECT page_id, any_value(content_hash(html)) AS hash, any_value(url_domain(url)) AS domain, count(l.position) AS links, round(any_value(garbage_ratio(html)), 6) AS garbage FROM {p} LEFT JOIN LATERAL page_links(url, html, 'a') l ON true GROUP BY page_id",
        p=table(spark, sf, "pages"),
    )
