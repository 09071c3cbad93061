"""Queries over the further text expressions, and vector searches of one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions import strings as S
from threatloom.functions import text as T
from threatloom.operators import vector_dedup, vectors
from threatloom.plans.registry import ARTICLES, query
from threatloom.views import articles, table

_FLAT = r"trim(regexp_replace({c}, '[ \t\r\n\f\v]+', ' ', 'g'))"


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("keep_newlines", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\f\v\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM documents")
def keep_newlines(spark, sf):
    return _docs(spark, sf).select("doc_id", T.keep_newlines(F.col("text")).alias("cleaned"))


@query("sentence_counts", r"SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g')), lambda s: s <> '')) AS INTEGER) AS sentences FROM documents")
def sentence_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(S.sentences(F.col("text"))).alias("sentences"))


@query("summaries")
def summaries(spark, sf):
    return _docs(spark, sf).select("doc_id", S.summary(F.col("text")).alias("summary"))


_PLAIN = "coalesce(text, '')"
for _found, _as in S.PLAIN_CHARACTERS.items():
    _PLAIN = f"replace({_PLAIN}, '{_found.replace(chr(39), chr(39) * 2)}', '{_as.replace(chr(39), chr(39) * 2)}')"
_PLAIN = rf"regexp_replace(strip_accents({_PLAIN}), '[^\p{{L}}\p{{N}}_ \t\r\n\f\v.,;:?]', ' ', 'g')"


@query("normal_form", f"SELECT doc_id, lower({_FLAT.replace('{c}', _PLAIN)}) AS form FROM documents")
def normal_form(spark, sf):
    return _docs(spark, sf).select("doc_id", S.normal_form(F.col("text")).alias("form"))


@query("content_hash_normalised", f"WITH {ARTICLES} SELECT article_id, sha256(lower({_FLAT.format(c='coalesce(title, {e})').format(e=chr(39) * 2)}) || chr(10) || lower({_FLAT.format(c='coalesce(content, {e})').format(e=chr(39) * 2)})) AS content_hash FROM articles")
def content_hash_normalised(spark, sf):
    return articles(spark, sf).select("article_id", S.content_hash_normalised(F.col("title"), F.col("content")).alias("content_hash"))


@query("fingerprints", f"WITH {ARTICLES}, w AS (SELECT article_id, regexp_extract_all(lower(concat_ws(' ', title, split_part(content, chr(10), 1))), '[A-Za-z0-9_]+') AS w FROM articles) SELECT article_id, md5(array_to_string(list_sort(list_distinct(list_filter(w, lambda x: length(x) > 3)))[:20], ' ')) AS fingerprint FROM w")
def fingerprints(spark, sf):
    return articles(spark, sf).select("article_id", S.fingerprint(F.col("title"), F.col("content")).alias("fingerprint"))


@query("span_forms", f"SELECT conv_id, turn, {_FLAT.format(c='translate(coalesce(text, {e}), {q}, {r})').format(e=chr(39) * 2, q=chr(39) + '‘’“”' + chr(39), r=chr(39) * 5 + chr(34) * 2 + chr(39))} AS form FROM conversations")
def span_forms(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.span_form(F.col("text")).alias("form"))


@query("caret_free", "SELECT doc_id, replace(text, '^', '') AS plain FROM documents")
def caret_free(spark, sf):
    return _docs(spark, sf).select("doc_id", S.without_carets(F.col("text")).alias("plain"))


@query("title_jaccard", f"""WITH {ARTICLES}, w AS (SELECT article_id, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[A-Za-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(source, '')), '[A-Za-z0-9_]+')) AS b FROM articles)
    SELECT article_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM w""")
def title_jaccard(spark, sf):
    return articles(spark, sf).select("article_id", F.round(S.token_jaccard(F.col("title"), F.col("source")), 6).alias("jaccard"))


@query("embedding_text", f"WITH {ARTICLES} SELECT article_id, concat_ws(chr(10), 'Title: ' || substr(title, 1, 200), 'Source: ' || substr(source, 1, 100), 'Score: ' || length(content), 'Content: ' || substr(content, 1, 3000)) AS embedding_text FROM articles")
def embedding_text(spark, sf):
    return articles(spark, sf).select("article_id", S.embedding_text(F.col("title"), F.col("source"), F.col("content"), F.length("content")).alias("embedding_text"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1))"


@query("least_length", f"SELECT page_id, CASE WHEN {_HOST} = 'example.org' THEN 90 WHEN {_HOST} LIKE '%.example.org' THEN 90 WHEN {_HOST} LIKE '%.example.net' THEN 120 ELSE 200 END AS least FROM pages")
def least_length(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.least_length(T.domain(F.col("url")), {"example.org": 90, "example.net": 120}).alias("least"))


#: A small set of tokens for reports over the synthetic documents; real ones are passed in.
PLATFORMS = {"packages": {"license": 3, "version": 2}, "people": {"mail": 2, "idiot": 3}, "keys": {"token": 3, "secret": 1}}


@query("platform_labels", "WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), w AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{p}' AS name, {' + '.join(f'''CASE WHEN contains(t, '{k}') THEN {v} ELSE 0 END''' for k, v in ts.items())} AS w FROM l" for p, ts in PLATFORMS.items()
) + "), m AS (SELECT *, max(w) OVER (PARTITION BY doc_id) AS top FROM w) SELECT doc_id, coalesce(list(name ORDER BY w DESC, name) FILTER (WHERE w >= 3 AND w * 2 >= top), []) AS platforms FROM m GROUP BY 1")
def platform_labels(spark, sf):
    return _docs(spark, sf).select("doc_id", S.platform_labels(F.col("text"), PLATFORMS).alias("platforms"))


_ONE = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _beside_first(spark, sf):
    """All vectors with that of id 0 beside them, in column q: one row is sent to all tasks. Without such a vector there are no rows."""
    e = table(spark, sf, "embeddings")
    one = e.where("vec_id = 0 AND embedding IS NOT NULL").select(F.col("embedding").alias("q")).limit(1)
    return e.join(F.broadcast(one), F.lit(True))


@query("vector_search", f"SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS similarity FROM embeddings, {_ONE} WHERE embedding IS NOT NULL ORDER BY similarity DESC, vec_id LIMIT 12")
def vector_search(spark, sf):
    """The twelve vectors nearest to that of id 0: a top-k search of one query."""
    return vectors.top_k(_beside_first(spark, sf), F.col("q"), 12).select("vec_id", "label", "similarity")


@query("vector_search_by_label", f"WITH s AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS similarity FROM embeddings, {_ONE} WHERE embedding IS NOT NULL) SELECT DISTINCT ON (label) label, vec_id, similarity, similarity >= 0.2 AS meets_threshold FROM s ORDER BY label, similarity DESC, vec_id")
def vector_search_by_label(spark, sf):
    """The first hit of each label, as chunk hits are reduced to one for each article; every label stays, with whether it meets the threshold."""
    return vectors.best_per_label(_beside_first(spark, sf), F.col("q"), threshold=0.2)


@query("section_similarity", "SELECT l_orderkey, l_linenumber, round(0.042 * l_discount + 0.042 * l_tax + 0.042 * l_discount + 0.874 * l_tax, 6) AS similarity FROM lineitem")
def section_similarity(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(vectors.section_similarity("l_discount", "l_tax", "l_discount", "l_tax"), 6).alias("similarity"))


@query("vector_classes")
def vector_classes(spark, sf):
    """All vectors by class of similar ones; found through projections, so it has no SQL: a test measures its recall against all pairs."""
    return vector_dedup.vector_classes(table(spark, sf, "embeddings"), threshold=0.85)
