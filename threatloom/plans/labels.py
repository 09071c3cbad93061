"""Queries over labels of texts and observables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions import text as T
from threatloom.functions.strings import platform_labels
from threatloom.operators import chunks, labels
from threatloom.plans.registry import ARTICLES, count_sql, keyword_sql, query, score_sql
from threatloom.plans.strings import PLATFORMS
from threatloom.views import articles, table

_POS = count_sql([w for tier, ws in T.KEYWORDS.items() if tier != "negative" for w in ws])
_NEG = count_sql(T.KEYWORDS["negative"])
_VERDICT = f"v AS (SELECT *, {_POS} AS p, {_NEG} AS q, {score_sql()} AS hs FROM articles)"
_CONFIDENCE = "round(CASE WHEN hs > 0 THEN least(1.0, hs / 100) ELSE coalesce(CAST(greatest(p, q) AS DOUBLE) / nullif(p + q, 0), 0) END, 6)"


@query("keyword_verdict", f"WITH {ARTICLES}, {_VERDICT} SELECT article_id, p > q AS positive, {_CONFIDENCE} AS confidence FROM v")
def keyword_verdict(spark, sf):
    positive, sure = labels.keyword_verdict(F.col("content"))
    return articles(spark, sf).select("article_id", positive.alias("positive"), F.round(sure, 6).alias("confidence"))


_WORDS = " + ".join(f"CAST(contains(lower(content), '{w}') AS INTEGER)" for w in labels.TECHNICAL)


@query("quality_scores", f"""WITH {ARTICLES} SELECT article_id, least(100, CASE WHEN length(content) > 500 THEN 20 WHEN length(content) > 200 THEN 10 ELSE 5 END + CASE WHEN length(title) > 20 THEN 10 ELSE 5 END
    + least(30, ({_WORDS}) * 5) + CASE WHEN length(content) > 10000 THEN 20 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 10 ELSE 5 END + CASE WHEN lang = 'en' THEN 10 ELSE 5 END) / 100 AS quality,
    least(100000, length(content) + 1000 + CASE WHEN lang = 'en' THEN 1000 ELSE 0 END) / 100000 AS cost FROM articles""")
def quality_scores(spark, sf):
    named, tagged = F.col("source").isNotNull(), F.col("lang") == "en"
    quality = labels.quality_score(F.col("title"), F.col("content"), named, tagged)
    return articles(spark, sf).select("article_id", quality.alias("quality"), labels.cost_estimate(F.col("content"), named, tagged).alias("cost"))


DIMENSIONS = ["licensing", "abuse", "credentials"]
ENTRIES = [("License", 2, ["licensing"]), ("copyright", 1, ["licensing"]), ("idiot", 2, ["abuse"]), ("trash", 1, ["abuse"]), ("token", 1, ["credentials", "licensing"]), ("password", 2, ["credentials"])]
_STRUCTS = ", ".join(
    "{'w': -(" + " + ".join(f"CASE WHEN contains(t, '{t.lower()}') THEN {w} ELSE 0 END" for t, w, of in ENTRIES if d in of) + f"), 'i': {i}, 'label': '{d}'" + "}" for i, d in enumerate(DIMENSIONS)
)


@query("dimension_labels", f"WITH l AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, list_transform(list_sort(list_filter([{_STRUCTS}], lambda x: x.w <= -2)), lambda x: x.label) AS labels FROM l")
def dimension_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", labels.dimension_labels(F.col("text"), ENTRIES, DIMENSIONS).alias("labels"))


PRODUCTS = {"apache": ["apache license", "apache"], "gpl": ["general public license", "gpl"], "mit": ["MIT License"]}


@query("product_mentions", "WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS product, concat_ws(',', {', '.join(f'''CASE WHEN contains(t, '{x.lower()}') THEN '{x}' END''' for x in ts)}) AS evidence FROM l" for name, ts in PRODUCTS.items()
) + ") SELECT * FROM p WHERE evidence <> ''")
def product_mentions(spark, sf):
    found = labels.products(table(spark, sf, "documents"), "doc_id", F.col("text"), PRODUCTS)
    return found.withColumn("evidence", F.array_join("evidence", ","))


KINDS = ["cmdline", "registry_artifacts", "network_indicators", "scheduled_tasks", "hunt_queries", "windows_services", "other"]
SYSTEMS = ["windows", "linux", "macos", "cross-platform"]


@query("observable_metadata", f"""WITH o AS (SELECT event_id, {KINDS!r}[1 + event_id % 7] AS kind, CASE event_type WHEN 'view' THEN ' Linux ' WHEN 'error' THEN 'macos' END AS own,
      CASE WHEN user_id % 3 = 0 THEN [{SYSTEMS!r}[1 + user_id % 4]] WHEN user_id % 3 = 1 THEN ['windows', 'linux'] ELSE CAST([] AS VARCHAR[]) END AS ps FROM events),
    p AS (SELECT *, lower(trim(own)) AS k, list_filter(ps, lambda x: x IN ('windows', 'linux', 'macos')) AS c FROM o),
    q AS (SELECT event_id, kind, CASE WHEN k IN ('windows', 'linux', 'macos') THEN k WHEN kind IN ('registry_artifacts', 'windows_services', 'scheduled_tasks') THEN 'windows' WHEN len(c) = 1 THEN c[1]
      WHEN len(ps) = 1 AND ps[1] = 'cross-platform' THEN 'cross-platform' ELSE 'unknown' END AS platform,
      CASE WHEN k IN ('windows', 'linux', 'macos') OR kind IN ('registry_artifacts', 'windows_services', 'scheduled_tasks') THEN 'high' WHEN len(c) = 1 OR (len(ps) = 1 AND ps[1] = 'cross-platform') THEN 'medium' ELSE 'low' END AS platform_confidence,
      CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.TELEMETRY.items())} ELSE kind END AS telemetry FROM p),
    r AS (SELECT *, CASE WHEN telemetry = 'process_creation' AND platform IN ('windows', 'linux') THEN platform || '/' || telemetry WHEN telemetry = 'network_connection' THEN CASE WHEN platform IN ('windows', 'linux') THEN platform || '/' || telemetry ELSE telemetry END
      WHEN telemetry = 'registry' THEN 'windows/registry_event' WHEN telemetry IN ('service_creation', 'scheduled_task') THEN 'windows/' || telemetry END AS logsource FROM q)
    SELECT *, logsource IS NOT NULL AND platform <> 'macos' AS eligible FROM r""")
def observable_metadata(spark, sf):
    """Events as observables: their kind, own platform and the platforms of their article are made from type and ids."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    rows = table(spark, sf, "events").select(
        "event_id",
        pick(KINDS, F.col("event_id") % 7).alias("kind"),
        F.when(F.col("event_type") == "view", " Linux ").when(F.col("event_type") == "error", "macos").alias("own"),
        F.when(F.col("user_id") % 3 == 0, F.array(pick(SYSTEMS, F.col("user_id") % 4)))
        .when(F.col("user_id") % 3 == 1, F.array(F.lit("windows"), F.lit("linux")))
        .otherwise(F.array().cast("array<string>"))
        .alias("ps"),
    )
    return labels.observable_metadata(rows, kind=F.col("kind"), platform=F.col("own"), article_platforms=F.col("ps")).drop("own", "ps")


_PLATFORM = ", ".join("{'w': -(" + " + ".join(f"CASE WHEN contains(t, '{k}') THEN {v} ELSE 0 END" for k, v in ts.items()) + f"), 'name': '{p}'" + "}" for p, ts in PLATFORMS.items())
SYSTEM_WORDS = ["license", "version", "token", "password"]


@query("system_labels", f"""WITH l AS (SELECT doc_id, lower(text) AS t, CASE WHEN source = 'web' THEN 'linux' END AS known FROM documents), p AS (SELECT *, list_filter([{_PLATFORM}], lambda x: x.w <= -3) AS s FROM l)
    SELECT doc_id, coalesce(known, list_sort(s)[1].name, CASE WHEN {" + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in SYSTEM_WORDS)} >= 3 THEN 'windows' END, 'unknown') AS system FROM p""")
def system_labels(spark, sf):
    d = table(spark, sf, "documents")
    words = labels.total([F.contains(F.lower("text"), F.lit(w)).cast("int") for w in SYSTEM_WORDS])
    known = F.when(F.col("source") == "web", "linux")
    return d.select("doc_id", labels.system_label(d, known=known, platforms=platform_labels(F.col("text"), PLATFORMS), windows_words=words).alias("system"))


ALIASES = {"view": "windows", "win": "windows", "click": "linux", "purchase": "macos", "osx": "macos"}


@query("adjudications", f"""WITH e AS (SELECT event_id, lower(event_type) AS t, event_id % 3 AS f, user_id % 2 AS u FROM events),
    n AS (SELECT *, list_filter([CASE t {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} END, CASE WHEN u = 1 THEN 'windows' END], lambda x: x IS NOT NULL) AS ns FROM e),
    d AS (SELECT event_id, f, t, CASE WHEN f = 2 THEN '' WHEN len(ns) = 2 AND ns[1] = ns[2] THEN ns[1] ELSE array_to_string(ns, ',') END AS platforms FROM n)
    SELECT event_id, platforms, CASE WHEN platforms = '' THEN 'low' WHEN f = 0 THEN 'high' ELSE 'medium' END AS confidence FROM d""")
def adjudications(spark, sf):
    """Answers made from events: fenced JSON, JSON inside prose, and prose alone."""
    body = F.concat(F.lit('{"platforms": ["'), F.initcap("event_type"), F.lit('", "'), F.when(F.col("user_id") % 2 == 1, " Win ").otherwise("beos"), F.lit('"], "confidence": "'))
    kind = F.col("event_id") % 3
    answer = (
        F.when(kind == 0, F.concat(F.lit("Verdict:\n```json\n"), body, F.lit('High"}\n``` {not this}')))
        .when(kind == 1, F.concat(F.lit("I think "), body, F.lit('certain"} fits')))
        .otherwise(F.lit("no idea"))
    )
    found, sure = labels.adjudication(answer, ALIASES)
    return table(spark, sf, "events").select("event_id", F.array_join(found, ",").alias("platforms"), sure.alias("confidence"))


@query("stage_reached", f"""WITH {ARTICLES}, r AS (SELECT l_partkey AS article_id, count(*) AS items, count(*) FILTER (WHERE l_returnflag = 'A') AS rules, max(l_discount) AS best, bool_or(l_linestatus = 'F') AS inconclusive FROM lineitem GROUP BY 1)
    SELECT article_id, CASE WHEN lang <> 'en' THEN 'platform' WHEN length(content) < 100 THEN 'junk' WHEN NOT coalesce(source = 'web', false) AND {score_sql()} < 2 THEN 'rank' WHEN coalesce(items, 0) = 0 THEN 'extract' WHEN coalesce(rules, 0) = 0 THEN 'rules'
      WHEN coalesce(best, 0) >= 0.08 AND NOT coalesce(inconclusive, false) THEN 'similarity' ELSE 'queued' END AS stage FROM articles LEFT JOIN r USING (article_id)""")
def stage_reached(spark, sf):
    """Order lines are an article's extracted items, its returned ones its rules."""
    found = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("article_id")).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("l_returnflag") == "A").alias("rules"), F.max("l_discount").alias("best"), F.bool_or(F.col("l_linestatus") == "F").alias("inconclusive")
    )
    a = articles(spark, sf).select("article_id", "lang", "source", F.length("content").alias("n"), T.hunt_score(F.col("content")).alias("hs")).join(found, "article_id", "left")
    stage = labels.stage_reached(
        supported=F.col("lang") == "en", junk=F.col("n") < 100, rank=F.col("hs"), threshold=2, bypass=F.coalesce(F.col("source") == "web", F.lit(False)), items=F.coalesce("items", F.lit(0)),
        rules=F.coalesce("rules", F.lit(0)), best=F.col("best"), known=0.08, inconclusive=F.coalesce("inconclusive", F.lit(False)),
    )
    return a.select("article_id", stage.alias("stage"))


_FOOTER = "(contains(x, 'Copyright') OR contains(x, 'released'))"


@query("trimmed_lines", f"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
    s AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'token') OR contains(lower(x), 'the')), true), 0) AS s FROM l),
    t AS (SELECT *, len(list_filter(ls[1:greatest(s - 1, 0)], lambda x: {_FOOTER} AND NOT contains(x, 'Home'))) > 0 AS early, ls[greatest(s, 1):] AS tail FROM s),
    e AS (SELECT *, coalesce(list_position(list_transform(tail, lambda x: {_FOOTER}), true), 0) AS e FROM t),
    k AS (SELECT doc_id, text, CASE WHEN s = 0 OR early THEN '' ELSE array_to_string(CASE WHEN e = 0 THEN tail ELSE tail[1:e - 1] END, chr(10) || chr(10)) END AS kept FROM e)
    SELECT doc_id, CASE WHEN length(trim(kept)) < 100 THEN text ELSE kept END AS trimmed FROM k""")
def trimmed_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", labels.trimmed_lines(F.col("text"), start=["license", "token", "the"], banner=["Home"], footer=["Copyright", "released"]).alias("trimmed"))


@query("author_names", r"""SELECT c_custkey, list_filter(list_transform([' By  ' || c_name, c_mktsegment || ' Writer', 'x', NULL], lambda a: regexp_replace(regexp_replace(trim(regexp_replace(a, '\s+', ' ', 'g')), '^(by|author:?)\s+', '', 'i'), '\s+(writer|author)$', '', 'i')),
    lambda a: length(a) > 2 AND length(a) < 100) AS authors FROM customer""")
def author_names(spark, sf):
    made = F.array(F.concat(F.lit(" By  "), "c_name"), F.concat("c_mktsegment", F.lit(" Writer")), F.lit("x"), F.lit(None).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", labels.author_names(made).alias("authors"))


@query("tag_names", r"""SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(list_filter(list_transform(list_concat(string_split(p_type, ' '), [' ' || p_brand || '!', p_brand, 'q', '##']), lambda t: lower(trim(t))), lambda t: length(t) BETWEEN 2 AND 50),
    lambda t: regexp_replace(t, '[^\p{L}\p{N}_\s-]', '', 'g')), lambda t: t <> '')))[1:10] AS tags FROM part""")
def tag_names(spark, sf):
    made = F.concat(F.split("p_type", " "), F.array(F.concat(F.lit(" "), "p_brand", F.lit("!")), F.col("p_brand"), F.lit("q"), F.lit("##")))
    return table(spark, sf, "part").select("p_partkey", labels.tag_names(made).alias("tags"))


@query("atom_text", """WITH a AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Image|' || p_name WHEN 2 THEN 'Image||' || p_name ELSE 'Image|endswith|all|' || p_name END AS atom FROM part)
    SELECT p_partkey, atom, CASE WHEN atom LIKE 'Image||%' THEN 'Image:' || substr(atom, 8) WHEN atom LIKE 'Image|endswith|%' THEN 'Image|endswith:' || substr(atom, 20) WHEN atom LIKE 'Image|%' THEN 'Image:' || substr(atom, 7) ELSE atom END AS shown FROM a""")
def atom_text(spark, sf):
    kind = F.col("p_size") % 4
    made = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat(F.lit("Image|"), "p_name")).when(kind == 2, F.concat(F.lit("Image||"), "p_name")).otherwise(F.concat(F.lit("Image|endswith|all|"), "p_name"))
    return table(spark, sf, "part").select("p_partkey", made.alias("atom")).withColumn("shown", labels.atom_text(F.col("atom")))


@query("chunk_filter", f"""WITH {ARTICLES}, s AS (SELECT article_id, content AS whole, unnest(range(0, greatest(length(content) - 200, 1), 800)) AS start FROM articles WHERE length(content) > 0),
    c AS (SELECT article_id, start, substr(whole, start + 1, 1000) AS content FROM s), v AS (SELECT *, {_POS} AS p, {_NEG} AS q, {score_sql()} AS hs FROM c),
    k AS (SELECT *, ({" OR ".join(map(keyword_sql, T.KEYWORDS["perfect"]))}) OR (p > q AND CASE WHEN hs > 0 THEN least(1.0, hs / 100) ELSE coalesce(CAST(greatest(p, q) AS DOUBLE) / nullif(p + q, 0), 0) END >= 0.05) AS keep FROM v)
    SELECT article_id, count(*) AS chunks, count(*) FILTER (WHERE keep) AS kept, CAST(coalesce(sum(length(content)) FILTER (WHERE keep), 0) AS BIGINT) AS kept_chars, md5(coalesce(string_agg(content, chr(10) || chr(10) ORDER BY start) FILTER (WHERE keep), '')) AS kept_md5 FROM k GROUP BY 1""")
def chunk_filter(spark, sf):
    kept = chunks.filtered_chunks(chunks.fixed_chunks(articles(spark, sf)), threshold=0.05)
    return kept.select("article_id", "chunks", "kept", "kept_chars", F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


@query("chunk_scores", f"""WITH {ARTICLES}, h AS (SELECT article_id, content AS whole FROM articles WHERE {score_sql()} > 5), s AS (SELECT article_id, whole, unnest(range(0, greatest(length(whole) - 200, 1), 800)) AS start FROM h WHERE length(whole) > 0),
    c AS (SELECT article_id, start, substr(whole, start + 1, 1000) AS content FROM s) SELECT article_id, CAST(start AS INTEGER) AS start, CAST(start + length(content) AS INTEGER) AS "end", {score_sql()} AS hunt_score FROM c""")
def chunk_scores(spark, sf):
    high = articles(spark, sf).where(T.hunt_score(F.col("content")) > 5)
    return chunks.fixed_chunks(high).select("article_id", "start", "end", T.hunt_score(F.col("chunk_text")).alias("hunt_score"))
