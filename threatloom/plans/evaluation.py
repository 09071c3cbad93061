"""Queries that score items and spans and compare metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.operators import evaluation as E
from threatloom.operators import spans
from threatloom.plans.registry import query
from threatloom.views import annotations, table

_KEY = r"regexp_replace(replace(replace(regexp_replace(lower({c}), '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g'), '[.]', '.'), '[:]', ':'), '[ \t\r\n\f\v]+', ' ', 'g')"
_ITEMS = "e AS (SELECT o_custkey AS article_id, o_orderpriority AS item FROM orders WHERE o_orderstatus = 'O'), a AS (SELECT o_custkey AS article_id, ' ' || upper(o_orderpriority) AS item FROM orders WHERE o_orderstatus = 'F')"


def _items(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("article_id"), "o_orderpriority", "o_orderstatus")
    return (
        o.where("o_orderstatus = 'O'").select("article_id", F.col("o_orderpriority").alias("item")),
        o.where("o_orderstatus = 'F'").select("article_id", F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("item")),
    )


_SCORED = f"""{_ITEMS}, b AS (SELECT article_id, {_KEY.format(c='item')} AS k, 1 AS e, 0 AS a FROM e UNION ALL SELECT article_id, {_KEY.format(c='item')}, 0, 1 FROM a),
    g AS (SELECT article_id, k, max(e) AS e, max(a) AS a FROM b WHERE k <> '' GROUP BY 1, 2),
    c AS (SELECT article_id, count(*) FILTER (WHERE e = 1 AND a = 1) AS matched, count(*) FILTER (WHERE a = 0) AS missed, count(*) FILTER (WHERE e = 0) AS extra FROM g GROUP BY 1),
    s AS (SELECT *, coalesce(round(matched / nullif(matched + extra, 0), 4), 0.0) AS precision, coalesce(round(matched / nullif(matched + missed, 0), 4), 0.0) AS recall FROM c)"""


@query("item_score", f"WITH {_SCORED} SELECT * FROM s")
def item_score(spark, sf):
    return E.item_scores(*_items(spark, sf))


@query("item_score_summary", f"WITH {_SCORED} SELECT CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extra) AS BIGINT) AS extra, round(sum(matched) / (sum(matched) + sum(extra)), 4) AS precision, round(sum(matched) / (sum(matched) + sum(missed)), 4) AS recall FROM s")
def item_score_summary(spark, sf):
    total = E.item_scores(*_items(spark, sf)).agg(*(F.sum(c).alias(c) for c in ("matched", "missed", "extra")))
    return total.withColumns({"precision": E.ratio(F.col("matched"), F.col("matched") + F.col("extra")), "recall": E.ratio(F.col("matched"), F.col("matched") + F.col("missed"))})


_SPANS = "g AS (SELECT DISTINCT l_orderkey AS article_id, l_partkey % 5000 AS s, l_partkey % 5000 + 40 + l_linenumber AS e FROM lineitem WHERE l_returnflag = 'N'), p AS (SELECT DISTINCT l_orderkey AS article_id, l_suppkey % 50 * 100 AS s, l_suppkey % 50 * 100 + 60 AS e FROM lineitem)"


def _spans(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("article_id", F.col("l_orderkey"))
    at, other = F.col("l_partkey") % 5000, F.col("l_suppkey") % 50 * 100
    gold = rows.where("l_returnflag = 'N'").select("article_id", at.alias("start"), (at + 40 + F.col("l_linenumber")).alias("end")).distinct()
    return gold, rows.select("article_id", other.alias("start"), (other + 60).alias("end")).distinct()


@query("span_overlap", f"""WITH {_SPANS} SELECT g.article_id, g.s AS gold_start, g.e AS gold_end, p.s AS pred_start, p.e AS pred_end,
    round((least(g.e, p.e) - greatest(g.s, p.s)) / (greatest(g.e, p.e) - least(g.s, p.s)), 6) AS overlap FROM g JOIN p ON g.article_id = p.article_id AND g.s < p.e AND p.s < g.e""")
def span_overlap(spark, sf):
    return E.span_overlap(*_spans(spark, sf))


# A greedy match by recursion over the gold spans of each article; o has the pairs, n the counts.
_GREEDY = """r AS (SELECT *, dense_rank() OVER (PARTITION BY article_id ORDER BY gold) AS i FROM o),
    l AS (SELECT article_id, i, list({'p': pred, 'o': micro, 'd': delta} ORDER BY micro DESC, pred) AS cs FROM r GROUP BY 1, 2),
    t AS (SELECT DISTINCT article_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(p BIGINT, o BIGINT, d BIGINT)[]) AS taken FROM l
        UNION ALL SELECT t.article_id, l.i, list_concat(t.taken, list_filter(cs, lambda c: NOT list_contains(list_transform(t.taken, lambda x: x.p), c.p))[:1]) FROM t JOIN l ON l.article_id = t.article_id AND l.i = t.i + 1),
    f AS (SELECT article_id, arg_max(taken, i) AS taken FROM t GROUP BY 1),
    m AS (SELECT article_id, len(taken) AS tp, CAST(coalesce(list_sum(list_transform(taken, lambda x: x.o)), 0) AS BIGINT) AS micro, CAST(coalesce(list_sum(list_transform(taken, lambda x: x.d)), 0) AS BIGINT) AS deltas FROM f),
    v AS (SELECT article_id, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(n_pred, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(coalesce(n_gold, 0) - coalesce(tp, 0) AS BIGINT) AS fn, coalesce(micro, 0) AS micro, coalesce(deltas, 0) AS deltas FROM n LEFT JOIN m USING (article_id)),
    w AS (SELECT article_id, tp, fp, fn, coalesce(floor(micro / 1000000 / nullif(tp, 0) * 10000 + 0.5) / 10000, 0) AS mean_overlap, coalesce(floor(deltas / nullif(tp, 0) * 10000 + 0.5) / 10000, 0) AS mean_delta,
        coalesce(floor(tp / nullif(tp + fp, 0) * 10000 + 0.5) / 10000, 0) AS precision, coalesce(floor(tp / nullif(tp + fn, 0) * 10000 + 0.5) / 10000, 0) AS recall, micro, deltas FROM v)"""


@query("span_metrics", f"""WITH RECURSIVE {_SPANS}, o AS (SELECT g.article_id, CAST(g.s * 100000 + g.e AS BIGINT) AS gold, CAST(p.s * 100000 + p.e AS BIGINT) AS pred, CAST(round(1000000 * round((least(g.e, p.e) - greatest(g.s, p.s)) / (greatest(g.e, p.e) - least(g.s, p.s)), 6)) AS BIGINT) AS micro,
    CAST(p.e - p.s - g.e + g.s AS BIGINT) AS delta FROM g JOIN p ON g.article_id = p.article_id AND g.s < p.e AND p.s < g.e WHERE round((least(g.e, p.e) - greatest(g.s, p.s)) / (greatest(g.e, p.e) - least(g.s, p.s)), 6) >= 0.1),
    n AS (SELECT * FROM (SELECT article_id, count(*) AS n_gold FROM g GROUP BY 1) FULL JOIN (SELECT article_id, count(*) AS n_pred FROM p GROUP BY 1) USING (article_id)), {_GREEDY} SELECT * EXCLUDE (micro, deltas) FROM w""")
def span_metrics(spark, sf):
    return E.span_metrics(*_spans(spark, sf), threshold=0.1)


# Sentences of a conversation are its annotated spans, clauses the predicted ones.
_TEXTS = r"""c AS (SELECT conv_id AS article_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
    gp AS (SELECT article_id, regexp_split_to_array(t, '[.!?]') AS a FROM c), pp AS (SELECT article_id, regexp_split_to_array(t, '[.!?,;]') AS a FROM c),
    g0 AS (SELECT article_id, unnest(range(len(a))) AS idx, unnest(a) AS text FROM gp), p0 AS (SELECT article_id, unnest(range(len(a))) AS idx, unnest(a) AS text FROM pp),
    g AS (SELECT article_id, idx, text, trim(regexp_replace(text, '[ 	
]+', ' ', 'g')) AS form, trim(text, chr(10) || ' ') AS strict FROM g0), p AS (SELECT article_id, idx, text, trim(regexp_replace(text, '[ 	
]+', ' ', 'g')) AS form, trim(text, chr(10) || ' ') AS strict FROM p0)"""
_RELAXED = f"""{_TEXTS}, gs AS (SELECT *, list_distinct(string_split(form, ' ')) AS ws FROM g), ps AS (SELECT *, list_distinct(string_split(form, ' ')) AS ws FROM p),
    x AS (SELECT gs.article_id, gs.idx AS gold, ps.idx AS pred, len(list_intersect(gs.ws, ps.ws)) AS s, len(gs.ws) + len(ps.ws) AS b, length(ps.form) - length(gs.form) AS delta FROM gs JOIN ps ON gs.article_id = ps.article_id AND least(len(gs.ws), len(ps.ws)) * 2 >= greatest(len(gs.ws), len(ps.ws))),
    o AS (SELECT article_id, gold, pred, CAST(round(s / (b - s) * 1000000) AS BIGINT) AS micro, CAST(delta AS BIGINT) AS delta FROM x WHERE s * 2 >= b - s),
    n AS (SELECT * FROM (SELECT article_id, count(*) AS n_gold FROM g GROUP BY 1) FULL JOIN (SELECT article_id, count(*) AS n_pred FROM p GROUP BY 1) USING (article_id)), {_GREEDY}"""


def _texts(spark, sf):
    whole = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("article_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("t"))
    cut = lambda pattern: whole.select("article_id", F.posexplode(F.split("t", pattern)).alias("idx", "text"))  # noqa: E731
    return cut("[.!?]"), cut("[.!?,;]")


@query("span_eval", f"WITH RECURSIVE {_RELAXED} SELECT * EXCLUDE (micro, deltas) FROM w")
def span_eval(spark, sf):
    return spans.span_metrics(*_texts(spark, sf)).drop("micro", "deltas")


@query("span_eval_totals", f"""WITH RECURSIVE {_RELAXED}, z AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) AS articles, count(*) FILTER (WHERE fp > 0) AS with_fp, sum(micro) AS micro, sum(deltas) AS deltas FROM w)
    SELECT tp, fp, fn, articles, floor(tp / (tp + fp) * 10000 + 0.5) / 10000 AS precision, floor(tp / (tp + fn) * 10000 + 0.5) / 10000 AS recall, floor(2 * tp / (2 * tp + fp + fn) * 10000 + 0.5) / 10000 AS f1, floor(micro / 1000000 / tp * 10000 + 0.5) / 10000 AS mean_overlap, floor(deltas / tp * 10000 + 0.5) / 10000 AS mean_delta, floor(with_fp / articles * 10000 + 0.5) / 10000 AS fp_rate_per_document FROM z""")
def span_eval_totals(spark, sf):
    return spans.totals(spans.span_metrics(*_texts(spark, sf)))


_STRICT = rf"""{_TEXTS}, gk AS (SELECT *, row_number() OVER (PARTITION BY article_id, strict ORDER BY idx) AS k FROM g), pk AS (SELECT *, row_number() OVER (PARTITION BY article_id, strict ORDER BY idx) AS k FROM p),
    gm AS (SELECT gk.article_id, gk.idx, gk.strict, pk.idx IS NOT NULL AS hit FROM gk LEFT JOIN pk USING (article_id, strict, k)), pm AS (SELECT pk.article_id, pk.idx, pk.strict, gk.idx AS until FROM pk LEFT JOIN gk USING (article_id, strict, k)),
    merged AS (SELECT gm.article_id, count(*) AS merged FROM gm WHERE NOT hit AND EXISTS (SELECT 1 FROM pm WHERE pm.article_id = gm.article_id AND (until IS NULL OR until > gm.idx) AND length(pm.strict) > length(gm.strict) * 1.5) GROUP BY 1),
    truncated AS (SELECT gm.article_id, count(*) AS truncated FROM gm WHERE EXISTS (SELECT 1 FROM pm WHERE pm.article_id = gm.article_id AND length(pm.strict) < length(gm.strict) * 0.7) GROUP BY 1),
    gw AS (SELECT article_id, list_distinct(regexp_extract_all(strict, '[^ 	
]+')) AS ws FROM gm), pw AS (SELECT article_id, idx, list_distinct(regexp_extract_all(strict, '[^ 	
]+')) AS ws FROM pm),
    odd AS (SELECT article_id, count(*) AS odd FROM pw WHERE len(ws) > 3 AND NOT EXISTS (SELECT 1 FROM gw WHERE gw.article_id = pw.article_id AND (list_has_all(gw.ws, pw.ws) OR list_has_all(pw.ws, gw.ws))) GROUP BY 1),
    a AS (SELECT article_id, count(*) AS n_gold, count(*) FILTER (WHERE hit) AS exact FROM gm GROUP BY 1), b AS (SELECT article_id, count(*) AS n_pred FROM pm GROUP BY 1),
    s AS (SELECT article_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(exact, 0) AS exact, coalesce(n_pred, 0) - coalesce(exact, 0) AS hallucinations, coalesce(merged, 0) AS merged, coalesce(truncated, 0) AS truncated, coalesce(odd, 0) AS argument_hallucinations, coalesce(n_pred, 0) = coalesce(exact, 0) AS zero_fp_pass
        FROM a FULL JOIN b USING (article_id) LEFT JOIN merged USING (article_id) LEFT JOIN truncated USING (article_id) LEFT JOIN odd USING (article_id))"""


@query("span_gold_metrics", f"WITH {_STRICT} SELECT * FROM s")
def span_gold_metrics(spark, sf):
    return spans.gold_metrics(*_texts(spark, sf))


@query("span_gold_failures", f"WITH {_STRICT} SELECT article_id, failure_type, n FROM (SELECT article_id, merged AS merged_commands, truncated AS truncated_span, argument_hallucinations AS argument_hallucination FROM s) UNPIVOT (n FOR failure_type IN (merged_commands, truncated_span, argument_hallucination)) WHERE n > 0")
def span_gold_failures(spark, sf):
    return spans.failure_rows(spans.gold_metrics(*_texts(spark, sf)))


_WIDE = "w AS (SELECT event_type, count(*) AS n, max(value) AS largest, min(value) AS least FROM events WHERE event_id % 2 = {k} GROUP BY 1), r AS (UNPIVOT w ON n, largest, least INTO NAME metric_name VALUE metric_value)"


def _runs(spark, sf):
    ev = table(spark, sf, "events")
    wide = lambda k: ev.where(F.col("event_id") % 2 == k).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"), F.min("value").alias("least"))  # noqa: E731
    return [E.metric_rows(wide(k), "event_type", ["n", "largest", "least"]) for k in (0, 1)]


_LONG = lambda k: " UNION ALL ".join(f"SELECT event_type, '{m}' AS metric_name, CAST({x} AS DOUBLE) AS v FROM events WHERE event_id % 2 = {k} GROUP BY 1" for m, x in (("n", "count(*)"), ("largest", "max(value)"), ("least", "min(value)")))  # noqa: E731


@query("metric_rows", f"SELECT event_type, metric_name, v AS metric_value FROM ({_LONG(0)})")
def metric_rows(spark, sf):
    """Even events are the run of which metrics are kept."""
    return _runs(spark, sf)[0]


@query("metric_comparison", f"""WITH x AS ({_LONG(0)}), y AS ({_LONG(1)}), d AS (SELECT event_type, metric_name, x.v AS a, round(y.v - x.v, 6) AS diff FROM x JOIN y USING (event_type, metric_name))
    SELECT event_type, metric_name, diff, round(diff * 100 / nullif(a, 0), 4) AS percent, CASE WHEN abs(diff) < 0.001 THEN 'unchanged' WHEN diff > 0 THEN 'improvement' ELSE 'degradation' END AS change FROM d""")
def metric_comparison(spark, sf):
    """Even and odd events are the two runs that are compared."""
    return E.metric_comparison(*_runs(spark, sf), "event_type")


@query("misclassified", "SELECT doc_id AS article_id, quality, toxic FROM labels WHERE (quality = 1) <> (toxic = 0)")
def misclassified(spark, sf):
    return E.misclassified(annotations(spark, sf), F.col("quality") == 1, F.col("toxic") == 0).select("article_id", "quality", "toxic")


@query("latest_version", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_version(spark, sf):
    return E.newest_version(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")


@query("metric_trend", "SELECT user_id, event_id, CAST(props ->> '$.k' AS INTEGER) AS value, lag(CAST(props ->> '$.k' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
def metric_trend(spark, sf):
    return E.metric_trend(table(spark, sf, "events"), "user_id", "event_id", F.get_json_object("props", "$.k").cast("int"))
