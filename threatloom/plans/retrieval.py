"""Queries over table changes, searches that build on hits, and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions import text as T
from threatloom.operators import changes, retrieval, search, vectors
from threatloom.operators.labels import lookup
from threatloom.plans.registry import ARTICLES, query, score_sql
from threatloom.sources import exports
from threatloom.views import annotations, articles, table


def _orders(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderstatus").alias("segment"), F.max(F.when(F.col("o_totalprice") > 300_000, F.col("o_orderpriority"))).alias("priority"))


@query("sync_plan", """WITH o AS (SELECT o_custkey AS id, min(o_orderstatus) AS segment, max(CASE WHEN o_totalprice > 300000 THEN o_orderpriority END) AS priority FROM orders GROUP BY 1),
    c AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_name AS priority FROM customer WHERE c_acctbal > 0), j AS (SELECT coalesce(o.id, c.id) AS id, o.id AS oi, c.id AS ci, o.segment AS os, c.segment AS cs, o.priority AS op, c.priority AS cp FROM o FULL JOIN c ON o.id = c.id)
    SELECT id, CASE WHEN oi IS NULL THEN 'insert' WHEN ci IS NOT NULL THEN 'update' ELSE 'delete' END AS action, CASE WHEN ci IS NULL THEN os ELSE cs END AS segment, CASE WHEN ci IS NULL THEN op ELSE coalesce(op, cp) END AS priority FROM j""")
def sync_plan(spark, sf):
    """Customers that ordered are stored, customers in credit are configured."""
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("priority"))
    return changes.sync_plan(_orders(spark, sf), c, "id", updated=["segment"], owned=["priority"])


@query("patched_rows", "SELECT doc_id, lang, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def patched_rows(spark, sf):
    patch = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("source"))
    return changes.patched(table(spark, sf, "documents").select("doc_id", "lang", "source"), patch, "doc_id", ["source"])


@query("changed_once_set", "SELECT doc_id, 'train' AS was, CASE WHEN toxic = 1 THEN 'eval' END AS now FROM labels WHERE quality = 1")
def changed_once_set(spark, sf):
    rows = table(spark, sf, "labels")
    before = rows.select("doc_id", F.when(F.col("quality") == 1, "train").alias("usage"))
    return changes.changed_once_set(before, rows.select("doc_id", F.when(F.col("toxic") == 1, "eval").alias("usage")), "doc_id", "usage")


@query("unused_feedback", "SELECT event_type, count(*) FILTER (WHERE NOT coalesce(value > 50, false)) AS taken, count(*) AS used_after FROM events GROUP BY 1")
def unused_feedback(spark, sf):
    taken, marked = changes.take_unused(table(spark, sf, "events").withColumn("used", F.col("value") > 50), "used")
    counts = marked.groupBy("event_type").agg(F.count_if("used").alias("used_after"))
    return counts.join(taken.groupBy("event_type").agg(F.count(F.lit(1)).alias("taken")), "event_type", "left").select("event_type", F.coalesce("taken", F.lit(0)).alias("taken"), "used_after")


@query("valid_vectors", "SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS valid FROM embeddings GROUP BY 1")
def valid_vectors(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(changes.valid_vector(F.col("embedding"), 64)).alias("valid"))


_M = ["late", "returned", "discounted"]


@query("version_differences", """WITH m AS (SELECT l_linestatus AS version, count(*) FILTER (WHERE l_quantity > 25) / count(*) AS late, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS returned, count(*) FILTER (WHERE l_discount > 0.05) / count(*) AS discounted FROM lineitem GROUP BY 1),
    r AS (UNPIVOT m ON late, returned, discounted INTO NAME metric VALUE value), c AS (SELECT a.metric, b.value - a.value AS d, a.value AS o FROM r a JOIN r b ON a.metric = b.metric AND a.version = 'F' AND b.version = 'O')
    SELECT metric, round(d, 4) AS change, round(coalesce(d * 100 / nullif(o, 0), 0), 1) AS percent, CASE WHEN d > 0.01 THEN 'improved' WHEN d < -0.01 THEN 'worse' ELSE 'same' END AS verdict FROM c""")
def version_differences(spark, sf):
    rate = lambda test: F.count_if(test) / F.count(F.lit(1))
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("version")).agg(
        rate(F.col("l_quantity") > 25).alias("late"), rate(F.col("l_returnflag") == "R").alias("returned"), rate(F.col("l_discount") > 0.05).alias("discounted")
    )
    return changes.version_differences(wide.unpivot("version", _M, "metric", "value"), "F", "O")


@query("rule_set_scores", """WITH m AS (SELECT l_orderkey AS article_id, l_suppkey AS atom, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS e, max(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS a FROM lineitem GROUP BY 1, 2 HAVING e + a > 0),
    n AS (SELECT article_id, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(a) AS BIGINT) AS actual, CAST(sum(e * a) AS BIGINT) AS shared FROM m GROUP BY 1)
    SELECT *, round(coalesce(shared / nullif(actual, 0), 0), 4) AS precision, round(coalesce(shared / nullif(expected, 0), 0), 4) AS recall FROM n""")
def rule_set_scores(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("atom"), "l_returnflag", "l_quantity")
    return changes.rule_set_scores(rows.where("l_returnflag <> 'R'"), rows.where("l_quantity > 10"))


_NAMES = {"1-urgent": "first", "urgent": "first", "2-high": "second", "5-low": "last"}


@query("name_aliases", f"SELECT o_orderpriority, count(*) AS n, max(CASE lower(trim(o_orderpriority)) {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _NAMES.items())} ELSE lower(trim(o_orderpriority)) END) AS name FROM orders GROUP BY 1")
def name_aliases(spark, sf):
    key = F.lower(F.trim("o_orderpriority"))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max(lookup(key, _NAMES, key)).alias("name"))


@query("ids_by_prefix", "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def ids_by_prefix(spark, sf):
    return table(spark, sf, "part").where(F.startswith("p_brand", F.lit("Brand#1"))).select("p_partkey", "p_brand")


@query("failure_rows", "WITH e AS (SELECT event_id, unnest(['slow', 'failed', 'odd']) AS failure, unnest([value > 90, event_type = 'error', user_id % 7 = 3]) AS hit FROM events) SELECT event_id, failure FROM e WHERE hit")
def failure_rows(spark, sf):
    """One row for each kind of failure that an event shows."""
    kinds = F.create_map(F.lit("slow"), F.col("value") > 90, F.lit("failed"), F.col("event_type") == "error", F.lit("odd"), F.col("user_id") % 7 == 3)
    return table(spark, sf, "events").select("event_id", F.explode(F.map_filter(kinds, lambda k, v: v)).alias("failure", "hit")).drop("hit")


@query("eval_summary", f"WITH {ARTICLES} SELECT quality, count(*) AS n, count(DISTINCT article_id) AS articles, min(length(content)) AS shortest, max(length(content)) AS longest, round(sum(length(content)) / count(content), 2) AS mean FROM labels JOIN articles ON doc_id = article_id GROUP BY 1")
def eval_summary(spark, sf):
    rows = annotations(spark, sf).join(articles(spark, sf).select("article_id", F.length("content").cast("long").alias("c")), "article_id")
    return rows.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("article_id").alias("articles"), F.min("c").alias("shortest"), F.max("c").alias("longest"), F.round(F.sum("c") / F.count("c"), 2).alias("mean")
    )


@query("annotation_list", f"WITH {ARTICLES} SELECT doc_id AS article_id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'not_relevant' END AS annotation_type, title, source, discovered_at FROM labels LEFT JOIN articles ON doc_id = article_id")
def annotation_list(spark, sf):
    return retrieval.annotation_list(annotations(spark, sf).select("article_id", "annotation_type"), articles(spark, sf))


@query("grouped_annotations", "SELECT user_id AS article_id, count(*) AS n, md5(string_agg(event_id || ':' || event_type, ',' ORDER BY event_id)) AS rows_md5 FROM events GROUP BY 1")
def grouped_annotations(spark, sf):
    grouped = retrieval.grouped_by_article(table(spark, sf, "events").withColumnRenamed("user_id", "article_id"), "event_id", "event_type")
    text = F.array_join(F.transform("annotations", lambda a: F.concat_ws(":", a["event_id"], a["event_type"])), ",")
    return grouped.select("article_id", F.size("annotations").cast("long").alias("n"), F.md5(text.cast("binary")).alias("rows_md5"))


_ONES = "list_transform(range(64), lambda x: CAST(1 AS DOUBLE))"
_HIT = f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_ONES}), 6) AS similarity FROM embeddings WHERE embedding IS NOT NULL"


@query("chunk_hits", f"""WITH {ARTICLES}, h AS ({_HIT}), c AS (SELECT CAST(floor(vec_id / 4) AS BIGINT) AS article_id, CAST(vec_id % 4 AS INTEGER) AS chunk, similarity FROM h), b AS (SELECT DISTINCT ON (article_id) * FROM c ORDER BY article_id, similarity DESC, chunk),
    s AS (SELECT article_id, {score_sql()} AS hunt_score FROM articles) SELECT article_id, chunk, similarity, hunt_score FROM b JOIN s USING (article_id) WHERE hunt_score >= 1 ORDER BY similarity DESC, article_id LIMIT 15""")
def chunk_hits(spark, sf):
    """Vectors are chunks, four to an article; the fifteen best articles: a top-k report."""
    one = F.array(*([F.lit(1.0)] * 64))
    hits = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select(
        F.floor(F.col("vec_id") / 4).alias("article_id"), (F.col("vec_id") % 4).cast("int").alias("chunk"), F.round(T.cosine(F.col("embedding"), one), 6).alias("similarity")
    )
    scored = articles(spark, sf).select("article_id", T.hunt_score(F.col("content")).alias("hunt_score"))
    return retrieval.chunk_hits(hits, scored, 15, least_score=1)


@query("unified_search", f"""WITH {ARTICLES} SELECT 'article' AS kind, article_id AS id, title, NULL AS rule_type FROM articles WHERE contains(lower(title), 'license') OR contains(lower(content), 'license')
    UNION ALL SELECT 'rule', p_partkey, NULL, p_type FROM part WHERE p_name ILIKE '%re%'""")
def unified_search(spark, sf):
    found = search.boolean_search(articles(spark, sf), "license").select(F.col("article_id").alias("id"), "title")
    rules = table(spark, sf, "part").where(F.ilike("p_name", F.lit("%re%"))).select(F.col("p_partkey").alias("id"), F.col("p_type").alias("rule_type"))
    return retrieval.unified(("article", found), ("rule", rules))


_PHRASES = ("license", "the", "token", "version", "copyright", "idiot")


@query("related_phrases", f"""WITH {ARTICLES}, h AS ({_HIT} ORDER BY similarity DESC, vec_id LIMIT 10), f AS (SELECT row_number() OVER (ORDER BY similarity DESC, article_id) AS rank, similarity, title, lower(concat_ws(' ', title, content)) AS t FROM h JOIN articles ON article_id = vec_id),
    p AS (SELECT unnest({list(_PHRASES)!r}) AS phrase, unnest(range({len(_PHRASES)})) AS pos), x AS (SELECT DISTINCT ON (phrase) phrase, similarity, title, rank, pos FROM f, p WHERE contains(t, phrase) ORDER BY phrase, rank)
    SELECT phrase, similarity, title FROM x ORDER BY rank, pos LIMIT 5""")
def related_phrases(spark, sf):
    """Five phrases out of the ten nearest articles: a top-k report."""
    near = vectors.top_k(table(spark, sf, "embeddings"), [1.0] * 64, 10).select(F.col("vec_id").alias("article_id"), "similarity")
    found = retrieval.ranked(articles(spark, sf).select("article_id", "title", "content").join(near, "article_id"), "article_id")
    return retrieval.related_phrases(found, 5, _PHRASES)


_RULES = "r AS (SELECT DISTINCT ON (label) label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL ORDER BY label, vec_id)"
NEAR = f"""{_RULES}, s AS (SELECT vec_id, r.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS similarity FROM embeddings, r WHERE embedding IS NOT NULL),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) <= 3), m AS (SELECT vec_id, label AS rule, round(similarity * 0.874, 6) AS similarity FROM k WHERE round(similarity * 0.874, 6) >= 0.2)"""


def rule_hits(spark, sf):
    """The three nearest rules of every vector; the first vector of each label is its rule, under a negative id."""
    v = table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    rules = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select((F.col("label") - 1_000_000_000).cast("long").alias("vec_id"), "label", "embedding")
    hits = vectors.top_k_per_query(rules, v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3)
    return hits.select(F.col("query_id").alias("vec_id"), F.col("label").alias("rule"), "similarity")


@query("article_rule_matches", f"WITH {NEAR} SELECT * FROM m")
def article_rule_matches(spark, sf):
    return retrieval.rule_matches(rule_hits(spark, sf), threshold=0.2)


@query("chunk_rule_matches", f"WITH {NEAR} SELECT CAST(floor(vec_id / 4) AS BIGINT) AS article_id, rule, max(similarity) AS similarity, arg_min(vec_id, (-similarity, vec_id)) AS vec_id FROM m GROUP BY 1, 2")
def chunk_rule_matches(spark, sf):
    """The best chunk of each article and rule."""
    hits = retrieval.rule_matches(rule_hits(spark, sf), threshold=0.2)
    return retrieval.best_per(hits.withColumn("article_id", F.floor(F.col("vec_id") / 4)), "article_id", "rule", tie="vec_id")


@query("match_summary", f"WITH {NEAR}, b AS (SELECT vec_id, count(*) AS matches, max(similarity) AS best FROM m GROUP BY 1) SELECT doc_id AS article_id, coalesce(matches, 0) AS matches, best, CASE WHEN best >= 0.6 THEN 'covered' WHEN best >= 0.3 THEN 'extend' ELSE 'new' END AS coverage FROM documents LEFT JOIN b ON doc_id = vec_id")
def match_summary(spark, sf):
    matches = retrieval.rule_matches(rule_hits(spark, sf), threshold=0.2).withColumnRenamed("vec_id", "article_id")
    return retrieval.match_summary(matches, articles(spark, sf), covered=0.6, extended=0.3)


@query("article_export", f"WITH {ARTICLES} SELECT article_id, source, title, concat_ws('; ', lang, source) AS tags FROM articles WHERE discovered_at >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY")
def article_export(spark, sf):
    rows = articles(spark, sf).withColumn("tags", F.array("lang", "source"))
    return exports.flat(exports.recent(rows, as_of="2024-02-01 00:00:00", days=30).select("article_id", "source", "title", "tags"))


@query("training_rows", "SELECT doc_id AS article_id, 'relevant' AS annotation_type, 'train' AS usage, false AS used FROM labels WHERE quality = 1 AND toxic <> 1")
def training_rows(spark, sf):
    a = annotations(spark, sf).select("article_id", "annotation_type", F.lit("train").alias("usage"), (F.col("toxic") == 1).alias("used"))
    return exports.training_rows(a, kind="relevant", usage="train")


@query("bundles", """WITH p AS (SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '"}') AS name_sha256, sha256('{"p_size":' || p_size || ',"p_type":"' || p_type || '"}') AS size_sha256 FROM part)
    SELECT *, sha256(name_sha256 || chr(10) || size_sha256) AS bundle_sha256 FROM p""")
def bundles(spark, sf):
    return exports.bundle(table(spark, sf, "part"), "p_partkey", {"name": ["p_name", "p_brand"], "size": ["p_type", "p_size"]})


@query("table_listing", "SELECT DISTINCT table_name, column_name, CAST(ordinal_position AS INTEGER) AS position FROM information_schema.columns WHERE table_name IN ('documents', 'labels', 'part')")
def table_listing(spark, sf):
    return exports.table_listing(spark, {name: table(spark, sf, name) for name in ("documents", "labels", "part")})
