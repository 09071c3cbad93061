"""Queries over web pages, feeds and sitemaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.plans.registry import query
from threatloom.sources import discovery, feeds, pages
from threatloom.views import table

_ENTITIES = lambda c: f"replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
_ARTICLE = r"regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1)"
_STRIPPED = _ENTITIES(rf"regexp_replace({_ARTICLE}, '\s*<[^>]*>\s*', '', 'g')")
_BODY = rf"CASE WHEN length(trim({_STRIPPED})) > 50 THEN {_ARTICLE} ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' ' || {_ARTICLE} END"
_LINES = rf"regexp_replace(regexp_replace(replace({_BODY}, '<br><p>', ' ' || chr(10) || ' ' || chr(10) || ' '), '<br>|</(p|div|h[1-6]|li)>', ' ' || chr(10) || ' ', 'g'), '<[^>]*>', ' ', 'g')"
_TIDY = rf"trim(regexp_replace(regexp_replace(regexp_replace({_ENTITIES(_LINES)}, '[^\S\n]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query("html_text", rf"SELECT page_id, regexp_replace({_TIDY}, '[^\x00-\x7F]+', ' ', 'g') AS text FROM pages")
def html_text(spark, sf):
    return pages.read_pages(table(spark, sf, "pages")).select("page_id", "text")


@query("html_meta", rf"SELECT page_id, {_ENTITIES("trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\r\n\f\v]+', ' ', 'g'))")} AS title, CAST(NULL AS VARCHAR) AS canonical, CAST([] AS VARCHAR[]) AS authors FROM pages")
def html_meta(spark, sf):
    return pages.read_pages(table(spark, sf, "pages")).select("page_id", "title", "canonical", "authors")


_CLEAN = r"NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0D\x0E-\x1F\x{FFFE}\x{FFFF}]') AND text <> ''"


@query("feed_entries", rf"SELECT doc_id AS feed, 0 AS entry, trim(regexp_replace(source, '[ \t\r\n\f\v]+', ' ', 'g')) AS title, 'https://example.org/' || doc_id AS url, TIMESTAMP '2024-01-31 10:00:00' + CAST(doc_id % 3 AS INTEGER) * INTERVAL 1 HOUR AS published, [lang] AS tags FROM documents WHERE {_CLEAN}")
def feed_entries(spark, sf):
    """Every document as a feed of one item, written as RSS and read back."""
    d = table(spark, sf, "documents").where(~F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0D\x0E-\x1F\x{FFFE}\x{FFFF}]") & (F.col("text") != ""))
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(
        F.lit("<rss version='2.0'><channel><item><title>"), safe("source"), F.lit("</title><link>https://example.org/"), F.col("doc_id").cast("string"),
        F.lit("</link><pubDate>Wed, 31 Jan 2024 1"), (F.col("doc_id") % 3).cast("string"), F.lit(":00:00 GMT</pubDate><category>"), safe("lang"),
        F.lit("</category><description>"), safe("text"), F.lit("</description></item></channel></rss>"),
    )
    return feeds.read_feeds(d.select("doc_id", item.alias("xml")), "doc_id", "xml").select("feed", "entry", "title", "url", "published", "tags")


@query("sitemap_urls", "SELECT page_id AS sitemap, 0 AS position, url FROM pages")
def sitemap_urls(spark, sf):
    """Every page's address as a sitemap of its own, written as XML and read back."""
    xml = F.concat(F.lit("<urlset><url><loc>\n "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    return feeds.sitemap_urls(table(spark, sf, "pages").select("page_id", xml.alias("xml")), "page_id", "xml")


_LINKS = r"""h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)))) AS position FROM pages),
    l AS (SELECT page_id, url, CAST(position AS INTEGER) AS position, label, regexp_replace(lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href), '/+$', '') AS address FROM h)"""


@query("page_links", f"WITH {_LINKS} SELECT page_id, position, trim(regexp_replace(label, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS label, address FROM l")
def page_links(spark, sf):
    return discovery.links(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "position", "label", "address")


@query("listing_links", f"WITH {_LINKS} SELECT DISTINCT url AS listing, address FROM l")
def listing_links(spark, sf):
    """Every page is a listing of its own; the entries of its lists are the articles."""
    p = table(spark, sf, "pages")
    return discovery.discover(p, p, "nav ul li a", "a.next")


@query("pattern_links", f"WITH {_LINKS} SELECT DISTINCT url, address FROM l WHERE regexp_matches(address, '^https?://[^/]+/t')")
def pattern_links(spark, sf):
    return discovery.by_pattern(table(spark, sf, "pages"), [r"https?://[^/]+/t"])
