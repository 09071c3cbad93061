"""The library's expressions as functions of SQL, for sessions that work with spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from threatloom.sources.discovery import PageLinks

_DOT = "aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v)"
#: Temporary functions by signature: what they return, and their expression. They are inlined into plans like any other expression.
FUNCTIONS = {
    "content_hash(c STRING)": ("STRING", "sha2(coalesce(c, ''), 256)"),
    "collapse_whitespace(c STRING)": ("STRING", r"trim(regexp_replace(c, '[ \\t\\r\\n\\f\\x0B]+', ' '))"),
    "hamming(a BIGINT, b BIGINT)": ("INT", "bit_count(a ^ b)"),
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", f"try_divide({_DOT.format(a='a', b='b')}, sqrt({_DOT.format(a='a', b='a')}) * sqrt({_DOT.format(a='b', b='b')}))"),
    "url_domain(u STRING)": ("STRING", r"lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1))"),
    "token_jaccard(a STRING, b STRING)": (
        "DOUBLE",
        r"CASE WHEN size(array_union(regexp_extract_all(lower(coalesce(a, '')), '[A-Za-z0-9_]+', 0), regexp_extract_all(lower(coalesce(b, '')), '[A-Za-z0-9_]+', 0))) = 0 THEN 1D "
        r"ELSE size(array_intersect(regexp_extract_all(lower(coalesce(a, '')), '[A-Za-z0-9_]+', 0), regexp_extract_all(lower(coalesce(b, '')), '[A-Za-z0-9_]+', 0))) / "
        r"size(array_union(regexp_extract_all(lower(coalesce(a, '')), '[A-Za-z0-9_]+', 0), regexp_extract_all(lower(coalesce(b, '')), '[A-Za-z0-9_]+', 0))) END",
    ),
    "garbage_ratio(c STRING)": ("DOUBLE", r"coalesce(try_divide(length(regexp_replace(c, '[^\\[\\]{}|\\\\]', '')), length(c)), 0D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, and page_links(url, html, selector) as a table function; returns their names."""
    for signature, (kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {expression}")
    spark.udtf.register("page_links", PageLinks)
    return [s.partition("(")[0] for s in FUNCTIONS] + ["page_links"]
