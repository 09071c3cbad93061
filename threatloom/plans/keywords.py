"""Queries over keyword places: raw spans, resolved spans, highlights and panel items, over the words of the report registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.operators import keywords as K
from threatloom.plans.registry import ARTICLES, query
from threatloom.views import articles

#: Words that overlap one another and stand side by side in the synthetic documents.
WORDS = {
    "perfect": ["token", "public license"],
    "good": ["licensed under", "general public license", "of the"],
    "lolbas": ["under the", "released under the", "|"],
    "intelligence": ["the", "apache license", "version 2.0"],
    "negative": ["the gnu general", "idiot", "$"],
}
_RANK = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(K.CATEGORIES))
_NAME = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CATEGORIES.items()) + " END"
# Cutting a text at a word gives the word's places; what stands beside a place is the end of a piece or, if that is empty, the word again.
_RAW = f"""{ARTICLES}, k(category, word) AS (VALUES {", ".join(f"('{c}', '{w}')" for c, ws in WORDS.items() for w in ws)}),
    s AS (SELECT article_id, category, word, string_split(lower(content), word) AS p FROM articles, k WHERE contains(lower(content), word)),
    u AS (SELECT article_id, category, word, unnest(range(1, len(p))) AS i, len(p) - 1 AS n, unnest(p[:-2]) AS a, unnest(p[2:]) AS b FROM s),
    m AS (SELECT *, sum(length(a)) OVER (PARTITION BY article_id, category, word ORDER BY i) + (i - 1) * length(word) AS pos,
        CASE WHEN a <> '' THEN right(a, 1) WHEN i > 1 THEN right(word, 1) ELSE '' END AS l, CASE WHEN b <> '' THEN left(b, 1) WHEN i < n THEN left(word, 1) ELSE '' END AS r FROM u),
    raw AS (SELECT article_id, CAST(pos AS INTEGER) AS start, CAST(pos + length(word) AS INTEGER) AS "end", word AS keyword, category FROM m WHERE word = '|' OR NOT (regexp_matches(l, '[a-z]') OR regexp_matches(r, '[a-z]')))"""
_RESOLVED = f"""{_RAW}, b AS (SELECT *, max("end") OVER (PARTITION BY article_id ORDER BY start, "end", keyword, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM raw),
    c AS (SELECT *, sum(CASE WHEN coalesce(before, -1) <= start THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY start, "end", keyword, category) AS cluster, CASE category {_RANK} END AS rank FROM b),
    o AS (SELECT *, row_number() OVER (PARTITION BY article_id, cluster ORDER BY category <> 'perfect', CASE WHEN category = 'perfect' THEN 0 ELSE start - "end" END, rank, start, keyword) AS rn FROM c),
    t AS (SELECT article_id, cluster, rn, start AS s, "end" AS e, [{{'s': start, 'e': "end", 'c': category}}] AS taken FROM o WHERE rn = 1 UNION ALL
        SELECT o.article_id, o.cluster, o.rn, o.start, o."end", CASE WHEN len(list_filter(taken, lambda x: x.s < o."end" AND x.e > o.start)) > 0 THEN taken ELSE list_append(taken, {{'s': o.start, 'e': o."end", 'c': o.category}}) END
        FROM t JOIN o ON o.article_id = t.article_id AND o.cluster = t.cluster AND o.rn = t.rn + 1),
    w AS (SELECT article_id, cluster, unnest(arg_max(taken, rn)) AS x FROM t GROUP BY 1, 2),
    d AS (SELECT w.article_id, w.x.s AS start, w.x.e AS "end", w.x.c AS category, c.category AS source, count(*) AS n FROM w JOIN c ON c.article_id = w.article_id AND c.cluster = w.cluster AND c.start < w.x.e AND c."end" > w.x.s GROUP BY 1, 2, 3, 4, 5),
    v AS (SELECT DISTINCT article_id, start, "end", category FROM d),
    g AS (SELECT *, lag("end") OVER x AS pe, lag(category) OVER x AS pc FROM v WINDOW x AS (PARTITION BY article_id ORDER BY start)),
    i AS (SELECT *, sum(CASE WHEN pe = start AND pc = category THEN 0 ELSE 1 END) OVER (PARTITION BY article_id ORDER BY start) AS island FROM g),
    j AS (SELECT i.article_id, island, source, CAST(sum(n) AS BIGINT) AS n FROM i JOIN d ON d.article_id = i.article_id AND d.start = i.start GROUP BY 1, 2, 3),
    z AS (SELECT article_id, island, min(start) AS start, max("end") AS "end", any_value(category) AS category FROM i GROUP BY 1, 2),
    y AS (SELECT article_id, island, string_agg(source, ',' ORDER BY CASE source {_RANK} END) AS sources, string_agg(source || ':' || n, ',' ORDER BY source) AS counts, string_agg({_NAME("source")}, ', ' ORDER BY CASE source {_RANK} END) AS names FROM j GROUP BY 1, 2),
    resolved AS (SELECT article_id, start, "end", category, sources, counts, 'Category: ' || {_NAME("category")} || CASE WHEN sources = category THEN '' WHEN starts_with(sources, category) THEN ' | Highest-priority match among: ' || names ELSE ' | More-specific match among: ' || names END AS title
        FROM z JOIN y USING (article_id, island))"""
_ESCAPED = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


def _counts(c="counts"):
    return F.array_join(F.transform(c, lambda x: F.concat(x["category"], F.lit(":"), x["n"].cast("string"))), ",").alias("counts")


@query("keyword_raw_spans", f"WITH {_RAW} SELECT * FROM raw")
def keyword_raw_spans(spark, sf):
    return K.raw_spans(articles(spark, sf), WORDS)


@query("keyword_spans", f"WITH RECURSIVE {_RESOLVED} SELECT * FROM resolved")
def keyword_spans(spark, sf):
    return K.resolved(articles(spark, sf), WORDS).select("article_id", "start", "end", "category", F.array_join("sources", ",").alias("sources"), _counts(), K.title(F.col("category"), F.col("sources")).alias("title"))


@query("keyword_highlights", f"""WITH RECURSIVE {_RESOLVED}, q AS (SELECT article_id, start, '<span class="keyword-highlight keyword-highlight--' || category || '" data-keyword-category="' || category || '" data-source-categories="' || sources || '" title="' || resolved.title || '">' || {_ESCAPED('substr(content, start + 1, "end" - start)')} || '</span>' AS shown,
    coalesce(lag("end") OVER (PARTITION BY article_id ORDER BY start), 0) AS prev, "end", content FROM resolved JOIN articles USING (article_id)),
    h AS (SELECT article_id, string_agg({_ESCAPED("substr(content, prev + 1, start - prev)")} || shown, '' ORDER BY start) || any_value({_ESCAPED('substr(content, e + 1)')}) AS html FROM (SELECT *, max("end") OVER (PARTITION BY article_id) AS e FROM q) GROUP BY 1)
    SELECT article_id, coalesce(html, {_ESCAPED("coalesce(content, '')")}) AS html FROM articles LEFT JOIN h USING (article_id)""")
def keyword_highlights(spark, sf):
    return K.highlights(articles(spark, sf), WORDS)


@query("keyword_panel", f"""WITH RECURSIVE {_RESOLVED}, q AS (SELECT article_id, category, start, trim(substr(content, start + 1, "end" - start)) AS text, unnest(string_split(counts, ',')) AS part FROM resolved JOIN articles USING (article_id)),
    p AS (SELECT article_id, category, lower(text) AS key, split_part(part, ':', 1) AS source, CAST(sum(CAST(split_part(part, ':', 2) AS BIGINT)) AS BIGINT) AS n FROM q WHERE text <> '' GROUP BY 1, 2, 3, 4),
    f AS (SELECT article_id, category, lower(text) AS key, arg_min(text, start) AS text FROM q WHERE text <> '' GROUP BY 1, 2, 3)
    SELECT article_id, category, any_value(text) AS text, string_agg(source, ',' ORDER BY CASE source {_RANK} END) AS sources, string_agg(source || ':' || n, ',' ORDER BY source) AS counts FROM p JOIN f USING (article_id, category, key) GROUP BY article_id, category, key""")
def keyword_panel(spark, sf):
    return K.panel(articles(spark, sf), WORDS).select("article_id", "category", "text", F.array_join("sources", ",").alias("sources"), _counts())
