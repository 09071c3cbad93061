"""The registered queries over the driver tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions import text as T
from threatloom.operators import chunks, dedup, reports, search, vectors
from threatloom.plans.registry import ARTICLES as _ARTICLES
from threatloom.plans.registry import CHECKS as _CHECKS
from threatloom.plans.registry import EXECUTIONS as _EXECUTIONS
from threatloom.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from threatloom.plans.registry import count_sql as _count_sql
from threatloom.plans.registry import keyword_sql as _keyword_sql
from threatloom.plans.registry import score_sql as _score_sql
from threatloom.views import annotations, articles, checks, executions, table

@query("source_quality_stats", f"""WITH {_ARTICLES}, k AS (SELECT doc_id AS article_id, max(quality) AS quality FROM labels GROUP BY 1)
    SELECT source, count(article_id) AS total_articles, count(*) FILTER (WHERE quality = 0) AS rejected_count, count(*) FILTER (WHERE quality = 1) AS chosen_count,
    count(*) FILTER (WHERE quality IS NULL) AS unclassified_count, round(count(*) FILTER (WHERE quality = 0) * 100.0 / count(*), 1) AS rejection_rate,
    round(count(*) FILTER (WHERE quality = 1) * 100.0 / count(*), 1) AS acceptance_rate FROM articles LEFT JOIN k USING (article_id) GROUP BY source""")
def source_quality_stats(spark, sf):
    return reports.source_quality_stats(articles(spark, sf), annotations(spark, sf))


@query("source_score_stats", f"""WITH {_ARTICLES}, s AS (SELECT source, {_score_sql()} AS hs FROM articles)
    SELECT source, count(*) FILTER (WHERE hs > 0) AS scored, floor(CAST(sum(CAST(round(hs * 10) AS BIGINT)) FILTER (WHERE hs > 0) AS BIGINT) / count(hs) FILTER (WHERE hs > 0) / 10 * 100 + 0.5) / 100.0 AS avg_score, max(hs) AS max_score FROM s GROUP BY source""")
def source_score_stats(spark, sf):
    return reports.source_score_stats(articles(spark, sf))


@query("hunt_score", f"WITH {_ARTICLES} SELECT article_id, {_score_sql()} AS hunt_score FROM articles")
def hunt_score(spark, sf):
    return articles(spark, sf).select("article_id", T.hunt_score(F.col("content")).alias("hunt_score"))


@query("daily_trend", f"WITH {_CHECKS} SELECT CAST(check_time AS DATE) AS day, count(*) AS n, count(DISTINCT source_id) AS sources FROM checks GROUP BY 1")
def daily_trend(spark, sf):
    return reports.daily_trend(checks(spark, sf))


@query("hourly_distribution", f"""WITH {_CHECKS}, h AS (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour), c AS (SELECT hour(check_time) AS hour, count(*) AS c FROM checks GROUP BY 1)
    SELECT h.hour, CAST(coalesce(c, 0) AS BIGINT) AS n FROM h LEFT JOIN c ON h.hour = c.hour""")
def hourly_distribution(spark, sf):
    return reports.hourly_distribution(checks(spark, sf))


@query("score_bands_daily", f"""WITH {_CHECKS} SELECT CAST(check_time AS DATE) AS day, count(*) FILTER (WHERE response_time >= 80) AS excellent,
    count(*) FILTER (WHERE response_time BETWEEN 60 AND 79) AS good, count(*) FILTER (WHERE response_time BETWEEN 40 AND 59) AS average,
    count(*) FILTER (WHERE response_time BETWEEN 20 AND 39) AS poor, count(*) FILTER (WHERE response_time < 20 OR response_time IS NULL) AS low FROM checks GROUP BY 1""")
def score_bands_daily(spark, sf):
    return reports.score_bands_daily(checks(spark, sf))


@query("check_overview", f"""WITH {_CHECKS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT success) AS failed,
    round(percentile_cont(0.5) WITHIN GROUP (ORDER BY response_time) FILTER (WHERE response_time > 0), 6) AS median_response,
    round(count(*) FILTER (WHERE NOT success) * 100.0 / count(*), 2) AS error_rate FROM checks""")
def check_overview(spark, sf):
    return reports.check_overview(checks(spark, sf))


@query("check_by_source", f"""WITH {_CHECKS} SELECT source_id, count(*) AS total, count(*) FILTER (WHERE NOT success) AS failed,
    round(percentile_cont(0.5) WITHIN GROUP (ORDER BY response_time) FILTER (WHERE response_time > 0), 6) AS median_response FROM checks GROUP BY 1""")
def check_by_source(spark, sf):
    return reports.check_by_source(checks(spark, sf))


@query("source_health", f"""WITH {_CHECKS}, l AS (SELECT source_id, max(check_time) FILTER (WHERE success) AS s FROM checks GROUP BY 1),
    d AS (SELECT date_diff('day', CAST(s AS DATE), CAST((SELECT max(check_time) FROM checks) AS DATE)) AS days FROM l)
    SELECT CASE WHEN days <= 0 THEN 'healthy' WHEN days <= 2 THEN 'warning' ELSE 'error' END AS status, count(*) AS n FROM d GROUP BY 1""")
def source_health(spark, sf):
    return reports.source_health(checks(spark, sf))


@query("running_health", f"""WITH {_CHECKS}, r AS (SELECT source_id, success, sum(CAST(success AS INTEGER)) OVER (PARTITION BY source_id ORDER BY check_time, check_id) AS run FROM checks),
    m AS (SELECT source_id, max(run) AS run FROM r GROUP BY 1)
    SELECT m.source_id, count(r.run) AS consecutive_failures FROM m LEFT JOIN r ON m.source_id = r.source_id AND m.run = r.run AND NOT r.success GROUP BY 1""")
def running_health(spark, sf):
    return reports.running_health(checks(spark, sf))


_RANGE = "CASE WHEN hs IS NULL OR hs = 0 THEN '0' WHEN hs < 20 THEN '1-19' WHEN hs < 40 THEN '20-39' WHEN hs < 60 THEN '40-59' WHEN hs < 80 THEN '60-79' WHEN hs < 100 THEN '80-99' ELSE '100' END"


@query("quality_distribution", f"""WITH {_ARTICLES}, s AS (SELECT {_score_sql()} AS hs FROM articles), c AS (SELECT {_RANGE} AS r, count(*) AS c FROM s GROUP BY 1),
    d(score_range, position) AS (VALUES ('0', 1), ('1-19', 2), ('20-39', 3), ('40-59', 4), ('60-79', 5), ('80-99', 6), ('100', 7))
    SELECT score_range, position, CAST(coalesce(c, 0) AS BIGINT) AS n FROM d LEFT JOIN c ON r = score_range""")
def quality_distribution(spark, sf):
    return reports.quality_distribution(articles(spark, sf))


_PAIRS = " UNION ALL ".join(f"SELECT hs, '{tier}' AS category, '{w}' AS keyword FROM s WHERE {_keyword_sql(w)}" for tier, ws in T.KEYWORDS.items() for w in ws)


@query("keyword_category_stats", f"""WITH {_ARTICLES}, s AS (SELECT content, {_score_sql()} AS hs FROM articles), p AS ({_PAIRS})
    SELECT category, keyword, count(*) AS frequency, floor(CAST(sum(CAST(round(hs * 10) AS BIGINT)) AS BIGINT) / count(hs) / 10 * 100 + 0.5) / 100.0 AS avg_impact FROM p GROUP BY 1, 2""")
def keyword_category_stats(spark, sf):
    return reports.keyword_stats(articles(spark, sf), T.KEYWORDS)


@query("keyword_explode_top", f"""WITH {_ARTICLES}, s AS (SELECT content, 0 AS hs FROM articles), p AS ({_PAIRS})
    SELECT keyword, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, keyword LIMIT 5""")
def keyword_explode_top(spark, sf):
    words = [w for ws in T.KEYWORDS.values() for w in ws]
    hits = articles(spark, sf).select(F.explode(T.matches(F.col("content"), words)).alias("keyword"))
    return hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword").limit(5)


@query("status_counts", f"""WITH {_EXECUTIONS} SELECT status, count(*) AS n, floor(CAST(sum(CAST(round(ranking_score * 100) AS BIGINT)) AS BIGINT) / count(ranking_score) / 100 * 100 + 0.5) / 100.0 AS avg_score, min(created_at) AS first_at, max(created_at) AS last_at FROM executions GROUP BY 1""")
def status_counts(spark, sf):
    return reports.status_counts(executions(spark, sf))


@query("newest_per_key", f"""WITH {_EXECUTIONS} SELECT DISTINCT ON (article_id) * FROM executions ORDER BY article_id, created_at DESC, execution_id DESC""")
def newest_per_key(spark, sf):
    return reports.newest_per_key(executions(spark, sf))


@query("version_comparison", f"""WITH {_EXECUTIONS}, a AS (SELECT article_id, count(*) AS n, floor(CAST(sum(CAST(round(ranking_score * 100) AS BIGINT)) AS BIGINT) / count(ranking_score) / 100 * 100 + 0.5) / 100.0 AS v FROM executions WHERE status = 'O' GROUP BY 1),
    b AS (SELECT article_id, count(*) AS n, floor(CAST(sum(CAST(round(ranking_score * 100) AS BIGINT)) AS BIGINT) / count(ranking_score) / 100 * 100 + 0.5) / 100.0 AS v FROM executions WHERE status = 'F' GROUP BY 1)
    SELECT article_id, CAST(coalesce(a.n, 0) AS BIGINT) AS attempts_a, CAST(coalesce(b.n, 0) AS BIGINT) AS attempts_b, a.v AS avg_a, b.v AS avg_b FROM a FULL JOIN b USING (article_id)""")
def version_comparison(spark, sf):
    return reports.version_comparison(executions(spark, sf))


@query("metric_pivot", f"""WITH {_CHECKS} SELECT source_id, {", ".join(f"count(*) FILTER (WHERE method = '{m}') AS {m}" for m in ("click", "error", "purchase", "signup", "view"))} FROM checks GROUP BY 1""")
def metric_pivot(spark, sf):
    return reports.metric_pivot(checks(spark, sf))


@query("confusion", """WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) AS fp,
    count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS fn, count(*) FILTER (WHERE quality <> 1 AND toxic <> 0) AS tn FROM labels)
    SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
    round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM c""")
def confusion(spark, sf):
    return reports.confusion(annotations(spark, sf))


@query("model_agreement", f"""WITH {_ARTICLES}, s AS (SELECT article_id, {_score_sql()} > 0 AS rule FROM articles), b AS (SELECT quality = 1 AS model, rule FROM labels JOIN s ON doc_id = article_id)
    SELECT count(*) AS total, count(*) FILTER (WHERE model = rule) AS agreement, count(*) FILTER (WHERE model AND NOT rule) AS model_only,
    count(*) FILTER (WHERE NOT model AND rule) AS rule_only, round(count(*) FILTER (WHERE model = rule) * 100.0 / count(*), 2) AS accuracy FROM b""")
def model_agreement(spark, sf):
    return reports.model_agreement(articles(spark, sf), annotations(spark, sf))


@query("conversation_metrics", """SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 2) AS avg_chars, max(turn) AS max_turn FROM conversations GROUP BY 1""")
def conversation_metrics(spark, sf):
    return reports.conversation_metrics(table(spark, sf, "conversations"))


@query("numbered_export", f"""WITH {_ARTICLES}, a AS (SELECT doc_id AS article_id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'not_relevant' END AS annotation_type FROM labels)
    SELECT row_number() OVER (ORDER BY article_id, annotation_type) AS record_number, article_id, annotation_type, title FROM a LEFT JOIN articles USING (article_id)""")
def numbered_export(spark, sf):
    return reports.numbered_export(articles(spark, sf), annotations(spark, sf))


@query("corpus_stats", f"""WITH {_ARTICLES} SELECT count(*) AS articles, count(DISTINCT source) AS sources, CAST(sum(length(content)) AS BIGINT) AS chars,
    min(discovered_at) AS first_at, max(discovered_at) AS last_at FROM articles""")
def corpus_stats(spark, sf):
    return reports.corpus_stats(articles(spark, sf))


@query("content_duplicates", f"WITH {_ARTICLES} SELECT sha256(content) AS content_hash, count(*) AS n, min(article_id) AS first_id FROM articles GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, sf):
    return dedup.content_duplicates(articles(spark, sf))


@query("dedup_stats", f"""WITH {_ARTICLES}, c AS (SELECT sha256(content) AS h, count(*) AS n FROM articles GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_contents, CAST(sum(n - 1) AS BIGINT) AS duplicates, max(n) AS largest_group, round(sum(n - 1) / sum(n) * 100, 2) AS duplicate_rate FROM c""")
def dedup_stats(spark, sf):
    return dedup.dedup_stats(articles(spark, sf))


_STOP = ", ".join(f"'{w}'" for w in dedup.STOP_WORDS)
_SIMHASH = f"""{_ARTICLES}, w AS (SELECT article_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, content)), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM articles),
    t AS (SELECT article_id, CAST('0x' || substr(md5(w), 17, 16) AS UBIGINT) AS h, count(*) AS c FROM w WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY article_id, w),
    b AS (SELECT article_id, b, sum(CASE WHEN (h >> CAST(b AS UBIGINT)) & 1 = 1 THEN c ELSE -c END) AS v FROM t, (SELECT unnest(range(64)) AS b) GROUP BY 1, 2),
    s AS (SELECT article_id, bit_or(CASE WHEN v > 0 THEN CAST(1 AS UBIGINT) << CAST(b AS UBIGINT) ELSE CAST(0 AS UBIGINT) END) AS u FROM b GROUP BY 1),
    hashes AS (SELECT article_id, coalesce(u, CAST(0 AS UBIGINT)) AS u FROM articles LEFT JOIN s USING (article_id))"""
_SIGNED = "CASE WHEN u >= 9223372036854775808 THEN CAST(CAST(u AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST(u AS BIGINT) END"


@query("simhash", f"WITH {_SIMHASH} SELECT article_id, {_SIGNED} AS simhash FROM hashes")
def simhash(spark, sf):
    return dedup.simhash(articles(spark, sf))


@query("near_duplicates", f"""WITH {_SIMHASH}, c AS (SELECT u, {_SIGNED} AS h, count(*) AS n, min(article_id) AS first_id FROM hashes GROUP BY u)
    SELECT x.first_id AS id_a, y.first_id AS id_b, x.n AS n_a, y.n AS n_b, CAST(bit_count(xor(x.u, y.u)) AS INTEGER) AS distance FROM c x JOIN c y ON x.h < y.h AND x.u % 16 = y.u % 16 AND bit_count(xor(x.u, y.u)) <= 3
    UNION ALL SELECT first_id, article_id, n, n, 0 FROM hashes JOIN c USING (u) WHERE article_id <> first_id""")
def near_duplicates(spark, sf):
    return dedup.near_duplicates(dedup.simhash(articles(spark, sf)))


@query("dedup_first_per_key", f"WITH {_ARTICLES} SELECT DISTINCT ON (source, title) article_id, source, lang, title FROM articles ORDER BY source, title, article_id")
def dedup_first_per_key(spark, sf):
    return dedup.first_per_key(articles(spark, sf).select("article_id", "source", "lang", "title"), "source", "title")


@query("batch_dedup", f"""WITH {_ARTICLES}, f AS (SELECT content, min(article_id) AS first_id FROM articles GROUP BY 1), k AS (SELECT DISTINCT content AS known FROM articles JOIN labels ON article_id = doc_id)
    SELECT article_id, CASE WHEN known IS NOT NULL THEN 'existing_content' WHEN article_id <> first_id THEN 'batch_content' ELSE 'accepted' END AS reason
    FROM articles JOIN f ON f.content IS NOT DISTINCT FROM articles.content LEFT JOIN k ON known IS NOT DISTINCT FROM articles.content""")
def batch_dedup(spark, sf):
    """All articles arrive as a batch; those that are annotated are stored already."""
    a = articles(spark, sf)
    return dedup.batch_dedup(a, a.join(annotations(spark, sf).select("article_id"), "article_id", "left_semi"))


def _boolean(name: str, text: str, where: str) -> None:
    @query(f"boolean_search_{name}", f"WITH {_ARTICLES}, l AS (SELECT article_id, lower(title) AS t, lower(content) AS c FROM articles) SELECT article_id FROM l WHERE {where}")
    def run(spark, sf):
        return search.boolean_search(articles(spark, sf), text).select("article_id")


_has = lambda w: f"(contains(t, '{w}') OR contains(c, '{w}'))"
_boolean("and", "licensed AND version", f"{_has('licensed')} AND {_has('version')}")
_boolean("or", "idiot OR scum", f"{_has('idiot')} OR {_has('scum')}")
_boolean("not", "licensed NOT apache", f"{_has('licensed')} AND NOT {_has('apache')}")
_boolean("phrase", '"general public license"', _has("general public license"))
_boolean("mixed", "the AND idiot OR clown", f"{_has('idiot')} AND ({_has('the')} OR {_has('clown')})")
_boolean("wildcard", "lice*ed", r"regexp_matches(t, '(^|[^\p{L}\p{N}_])lice[\p{L}\p{N}_]*ed([^\p{L}\p{N}_]|$)') OR regexp_matches(c, '(^|[^\p{L}\p{N}_])lice[\p{L}\p{N}_]*ed([^\p{L}\p{N}_]|$)')")


@query("lexical_search", f"""WITH {_ARTICLES} SELECT article_id, source, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS content, CAST(0.35 AS DOUBLE) AS similarity
    FROM articles WHERE title ILIKE '%license%' OR content ILIKE '%license%' OR title ILIKE '%token%' OR content ILIKE '%token%' ORDER BY discovered_at DESC, article_id DESC LIMIT 20""")
def lexical_search(spark, sf):
    return search.lexical_search(articles(spark, sf), ["license", "token"])


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query("vector_topk_per_query", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def vector_topk_per_query(spark, sf):
    """Vectors whose id is divisible by 50 are the query set; all vectors are searched."""
    v = table(spark, sf, "embeddings")
    return vectors.top_k_per_query(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


@query("vector_topk_by_label", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS k FROM s),
    r AS (SELECT query_id, vec_id, label, similarity, CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id, query_id) AS INTEGER) AS rank FROM t WHERE k <= 10)
    SELECT label, rank, similarity FROM r WHERE rank <= 5""")
def vector_topk_by_label(spark, sf):
    v = table(spark, sf, "embeddings")
    found = vectors.top_k_per_query(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)
    return vectors.top_per_label(found.drop("rank"), 5).select("label", "rank", "similarity")


@query("label_centroids", """WITH p AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings)
    SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean, count(*) AS n FROM p GROUP BY 1, 2""")
def label_centroids(spark, sf):
    return vectors.label_centroids(table(spark, sf, "embeddings"))


@query("chunks_fixed", f"""WITH {_ARTICLES}, s AS (SELECT article_id, content, unnest(range(0, greatest(length(content) - 200, 1), 800)) AS start FROM articles WHERE length(content) > 0)
    SELECT article_id, CAST(start / 800 AS INTEGER) AS chunk, CAST(start AS INTEGER) AS start, CAST(least(start + 1000, length(content)) AS INTEGER) AS "end", substr(content, start + 1, 1000) AS chunk_text FROM s""")
def chunks_fixed(spark, sf):
    return chunks.fixed_chunks(articles(spark, sf))


@query("chunks_sentence", f"""WITH RECURSIVE {_ARTICLES}, c AS (SELECT article_id, content, length(content) AS n, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS "end" FROM articles WHERE length(content) > 0),
    e AS (SELECT article_id, content, n, chunk, start, CASE WHEN start + 1000 < n AND strpos(reverse(substr(content, start + 901, 100)), '.') > 0 THEN start + 1001 - strpos(reverse(substr(content, start + 901, 100)), '.') ELSE least(start + 1000, n) END AS "end" FROM c
        UNION ALL SELECT article_id, content, n, chunk + 1, s, CASE WHEN s + 1000 < n AND strpos(reverse(substr(content, s + 901, 100)), '.') > 0 THEN s + 1001 - strpos(reverse(substr(content, s + 901, 100)), '.') ELSE least(s + 1000, n) END FROM (SELECT *, greatest("end" - 200, start + 1) AS s FROM e WHERE "end" < n))
    SELECT article_id, CAST(chunk AS INTEGER) AS chunk, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", substr(content, start + 1, "end" - start) AS chunk_text FROM e""")
def chunks_sentence(spark, sf):
    return chunks.sentence_chunks(articles(spark, sf))


@query("chunk_features", f"""WITH {_ARTICLES}, w AS (SELECT *, greatest(len(regexp_extract_all(content, '[A-Za-z0-9]+')), 1) AS w, greatest(length(content), 1) AS n FROM articles)
    SELECT article_id, CAST(length(content) AS INTEGER) AS chars, CAST(len(regexp_extract_all(content, '[A-Za-z0-9]+')) AS INTEGER) AS words, CAST(len(regexp_extract_all(content, '[.!?]+')) AS INTEGER) AS sentence_marks,
    round(length(regexp_replace(content, '[^A-Z]', '', 'g')) / n, 4) AS upper_ratio, round(length(regexp_replace(content, '[^0-9]', '', 'g')) / n, 4) AS digit_ratio,
    round(length(regexp_replace(content, '[^A-Za-z0-9]', '', 'g')) / w, 4) AS chars_per_word,
    CAST(len(regexp_extract_all(content, '\\b[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\b')) AS INTEGER) AS addresses,
    CAST(len(regexp_extract_all(content, '\\b[0-9a-f]{{32,64}}\\b')) AS INTEGER) AS hashes, CAST(len(regexp_extract_all(content, 'https?://')) AS INTEGER) AS links,
    {", ".join(f"CAST({_count_sql(ws)} AS INTEGER) AS {tier}_matches" for tier, ws in T.KEYWORDS.items())} FROM w""")
def chunk_features(spark, sf):
    return chunks.chunk_features(articles(spark, sf))


@query("technique_ids", f"WITH {_ARTICLES} SELECT article_id, list_sort(list_distinct(regexp_extract_all(content, '\\bT[0-9]{{4}}(?:\\.[0-9]{{3}})?\\b'))) AS techniques FROM articles")
def technique_ids(spark, sf):
    return chunks.technique_ids(articles(spark, sf))


@query("quality_gate", f"""WITH {_ARTICLES} SELECT article_id, CASE WHEN length(content) < 100 THEN 'too_short'
    WHEN length(content) < 2000 AND ({" OR ".join(f"contains(lower(content), '{x}')" for x in chunks.BLOCK_PAGES)}) THEN 'block_page' WHEN len(regexp_extract_all(content, '[^ \\t\\r\\n\\f\\v]+')) < 50 THEN 'too_few_words'
    WHEN length(regexp_replace(content, '[^.!?]', '', 'g')) < 2 THEN 'no_sentences' ELSE 'ok' END AS reason FROM articles""")
def quality_gate(spark, sf):
    return chunks.quality_gate(articles(spark, sf))


@query("whitespace_clean", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g')) AS cleaned FROM documents")
def whitespace_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("cleaned"))


@query("ascii_clean", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[^\x00-\x7F]+', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')) AS cleaned FROM documents""")
def ascii_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ascii_clean(F.col("text")).alias("cleaned"))


_MASKED = "text"
for _p, _name in T.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '{_name}', 'g')"


@query("mask_values", f"SELECT doc_id, {_MASKED} AS masked FROM documents")
def mask_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.mask_values(F.col("text")).alias("masked"))


@query("garbage_filter", r"SELECT doc_id, round(coalesce(length(regexp_replace(text, '[^\[\]{}|\\]', '', 'g')) / nullif(length(text), 0), 0), 6) AS garbage FROM documents")
def garbage_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.garbage_ratio(F.col("text")), 6).alias("garbage"))


@query("url_domain", r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS domain FROM pages")
def url_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


_TRACK = ", ".join(f"'{x}'" for x in T.TRACKING)
_DATES = ", ".join(f"try_strptime(concat_ws('-', regexp_extract(url, '{p}', 1), lpad(regexp_extract(url, '{p}', 2), 2, '0'), lpad(regexp_extract(url, '{p}', 3), 2, '0')), '%Y-%m-%d')" for p in T.URL_DATES)


@query("url_normalize", f"""WITH u AS (SELECT page_id, url, regexp_replace(trim(url), '/+$', '') AS v FROM pages),
    q AS (SELECT page_id, url, split_part(v, '?', 1) AS base, list_filter(string_split(CASE WHEN contains(v, '?') THEN substr(v, strpos(v, '?') + 1) ELSE '' END, '&'), lambda p: contains(p, '=') AND lower(split_part(p, '=', 1)) NOT IN ({_TRACK})) AS kept FROM u)
    SELECT page_id, regexp_replace(lower(split_part(CASE WHEN len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END, '#', 1)), '^www\\.', '') AS url, CAST(coalesce({_DATES}) AS DATE) AS published FROM q""")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"), T.url_date(F.col("url")).alias("published"))


@query("html_title", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


from threatloom.plans import classifier, comparison, coverage, evaluation, keywords, labels, listings, pages, retrieval, rule_scores, rules, snippets, streams, strings, summaries  # noqa: E402, F401  (they register their queries)
