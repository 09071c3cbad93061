"""Queries over attention snippets and command-line candidates; a few words of the synthetic documents stand for anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.operators import snippets as S
from threatloom.plans.registry import ARTICLES, query
from threatloom.views import articles

#: Anchors that stand in the synthetic documents.
WORDS = ("token =", "licensed under", "idiot", "example.com", " in the ", "que la")
_LINES = r"""c AS (SELECT article_id, regexp_split_to_array(coalesce(content, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS a FROM articles),
    d AS (SELECT article_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM c),
    l AS (SELECT article_id, unnest(range(len(a))) AS no, unnest(a) AS line, a FROM d)"""
_STRIP = lambda x: rf"regexp_replace({x}, '^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$', '', 'g')"
_ANY = " OR ".join(f"contains(lower(line), '{w}')" for w in WORDS)
_SNIPPETS = rf"""{ARTICLES}, {_LINES}, t AS (SELECT *, CASE WHEN no > 0 THEN a[no] END AS b, a[no + 2] AS f FROM l WHERE ({_ANY}) AND {_STRIP("line")} <> ''),
    s AS (SELECT article_id, no, 0 AS k, {_STRIP("concat_ws(chr(10), b, line, f)")} AS snippet FROM t WHERE length(line) <= 500),
    w(word) AS (VALUES {", ".join(f"('{w}')" for w in WORDS)}),
    q AS (SELECT article_id, no, word, string_split(lower(line), word) AS p FROM t, w WHERE length(line) > 500 AND contains(lower(line), word)),
    u AS (SELECT article_id, no, word, unnest(range(1, len(p))) AS i, unnest(p[:-2]) AS x FROM q),
    m AS (SELECT article_id, no, word, sum(length(x)) OVER (PARTITION BY article_id, no, word ORDER BY i) + (i - 1) * length(word) AS pos FROM u),
    g AS (SELECT m.article_id, m.no, CAST(greatest(0, pos - 350) AS BIGINT) AS ws, CAST(least(length(line), pos + length(word) + 350) AS BIGINT) AS we FROM m JOIN t ON t.article_id = m.article_id AND t.no = m.no),
    h AS (SELECT *, max(we) OVER (PARTITION BY article_id, no ORDER BY ws, we ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM g),
    o AS (SELECT *, sum(CASE WHEN pe IS NULL OR ws > pe THEN 1 ELSE 0 END) OVER (PARTITION BY article_id, no ORDER BY ws, we) AS island FROM h),
    n AS (SELECT article_id, no, island, min(ws) AS ws, max(we) AS we FROM o GROUP BY 1, 2, 3),
    e AS (SELECT n.article_id, n.no, CAST(island - 1 AS INTEGER) AS k, b, f, {_STRIP("substr(line, greatest(0, ws - 350) + 1, least(length(line), we + 350) - greatest(0, ws - 350))")} AS piece FROM n JOIN t ON t.article_id = n.article_id AND t.no = n.no),
    z AS (SELECT article_id, no, k, CASE WHEN k = 0 AND (coalesce(b, '') <> '' OR coalesce(f, '') <> '') THEN {_STRIP("concat_ws(chr(10), nullif(b, ''), piece, nullif(f, ''))")} ELSE piece END AS snippet FROM e WHERE piece <> ''),
    y AS (SELECT article_id, snippet, min(no * 1000000 + k) AS pos FROM (SELECT * FROM s UNION ALL SELECT * FROM z) WHERE snippet <> '' GROUP BY 1, 2)"""


@query("attention_snippets", f"WITH {_SNIPPETS} SELECT article_id, CAST(row_number() OVER (PARTITION BY article_id ORDER BY pos) AS INTEGER) AS position, snippet FROM y")
def attention_snippets(spark, sf):
    return S.attention_snippets(articles(spark, sf), S.command_rules(WORDS, ("\\x00never",)))


@query("tree_snippets")
def tree_snippets(spark, sf):
    """Process-tree snippets by the fixed anchors."""
    return S.attention_snippets(articles(spark, sf), S.tree_rules())


#: Patterns whose matches hold one another in the synthetic documents.
PATTERNS = (r"under the [^\r\n]+", r"(?:licensed|released) under [^\r\n]+", r"version [0-9.]+", r"[a-z0-9]+@[a-z0-9.]+", r"mail[0-9][a-z0-9.]+ [^\r\n ]+")
_FOUND = "list_concat(" * (len(PATTERNS) - 1) + f"regexp_extract_all(content, '(?i){PATTERNS[0]}')" + "".join(f", regexp_extract_all(content, '(?i){p}'))" for p in PATTERNS[1:])
_POS = "coalesce(list_position(list_transform(acc, lambda e: contains(e, y[1]) OR contains(y[1], e)), true), 0)"
_CANDIDATES = rf"""{ARTICLES}, f AS (SELECT article_id, list_transform({_FOUND}, lambda x: [{_STRIP("x")}]) AS fs FROM articles WHERE content IS NOT NULL),
    k AS (SELECT article_id, list_reduce(fs, lambda acc, y: CASE WHEN {_POS} = 0 THEN list_concat(acc, y) WHEN contains(acc[{_POS}], y[1]) THEN acc ELSE list_concat(list_concat(acc[1:{_POS} - 1], y), acc[{_POS} + 1:]) END) AS ks FROM f WHERE len(fs) > 0),
    cand AS (SELECT article_id, CAST(unnest(range(1, len(ks) + 1)) AS INTEGER) AS position, unnest(ks) AS candidate FROM k)"""


@query("command_candidates", f"WITH {_CANDIDATES} SELECT * FROM cand")
def command_candidates(spark, sf):
    return S.command_candidates(articles(spark, sf), PATTERNS)


@query("candidate_lines", f"WITH {_CANDIDATES}, {_LINES}, r AS (SELECT cand.*, no, line, CASE WHEN no > 0 THEN a[no] END AS b, a[no + 2] AS f FROM cand JOIN l ON l.article_id = cand.article_id AND contains(line, candidate)) SELECT DISTINCT ON (article_id, position) article_id, position, candidate, CAST(no AS INTEGER) AS no, line, coalesce(b, '') AS before, coalesce(f, '') AS after FROM r ORDER BY article_id, position, no")
def candidate_lines(spark, sf):
    a = articles(spark, sf)
    found = S.candidate_lines(S.command_candidates(a, PATTERNS), a)
    return found.withColumns({"before": F.array_join("before", ""), "after": F.array_join("after", "")})
