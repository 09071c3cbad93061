"""Feeds and sitemaps as rows: each text is one XML document, read inside Arrow batches."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "entry int, title string, url string, content string, published timestamp_ntz, authors array<string>, tags array<string>"


def plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def date_of(text: str | None):
    """The date of an entry without its zone, in UTC; none if it doesn't parse or lies in 1970 or before."""
    if not text:
        return None
    try:
        from datetime import UTC, datetime

        try:
            found = parsedate_to_datetime(text.strip())
        except (TypeError, ValueError):
            found = datetime.fromisoformat(text.strip())
        found = found.astimezone(UTC).replace(tzinfo=None) if found.tzinfo else found
        return found if found.year > 1970 else None
    except ValueError:
        return None


def entries_of(xml: str | None) -> list[tuple] | None:
    """The entries of an RSS or Atom document; None if it doesn't parse.

    Content is the Atom content, else the description, else the summary; the date the published, else the updated, else the created one.
    """
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    out = []
    for i, item in enumerate(e for e in root.iter() if plain(e.tag) in ("item", "entry")):
        by: dict[str, list] = {}
        for child in item:
            by.setdefault(plain(child.tag), []).append(child)
        text = lambda *names: next((t for n in names for e in by.get(n, []) if (t := "".join(e.itertext()).strip())), None)
        link = next((e.get("href") for e in by.get("link", []) if e.get("href") and e.get("rel", "alternate") == "alternate"), None) or text("link", "guid", "id")
        people = [" ".join("".join(n.itertext()).split()) for e in by.get("author", []) + by.get("creator", []) for n in (list(e) and [c for c in e if plain(c.tag) == "name"] or [e])]
        words = {t for e in by.get("category", []) if (t := (e.get("term") or e.text or "").strip())}
        title = re.sub(r"\s+", " ", text("title") or "")
        out.append((i, title, link, text("content", "encoded", "description", "summary"), date_of(text("pubDate", "published", "date", "updated", "created")), list(dict.fromkeys(p for p in people if p)), sorted(words)))
    return out


def read_feeds(feeds: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each entry of each feed (key, XML text). A feed that doesn't parse gives one row with a null entry."""
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.timestamp("us"), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["feed", *(f.split(" ")[0] for f in ENTRY.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for feed, xml in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = entries_of(xml)
                rows += [(feed, *e) for e in found] if found is not None else [(feed, None, None, None, None, None, [], [])]
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), *kinds], strict=True)], names=names)

    return feeds.select(F.col(key).cast("long"), column).mapInArrow(run, "feed long, " + ENTRY)


def sitemap_urls(sitemaps: DataFrame, key: str, column: str) -> DataFrame:
    """Every address in a sitemap's loc elements, by a pattern that also holds for broken documents."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return sitemaps.select(F.col(key).alias("sitemap"), F.posexplode(found).alias("position", "url")).withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&")))


def posts(responses: DataFrame, key: str, column: str) -> DataFrame:
    """Posts of JSON responses: arrays of objects with link, date and rendered title and content; the excerpt where the content is short."""
    one = "array<struct<link:string,guid:struct<rendered:string>,date:string,title:struct<rendered:string>,content:struct<rendered:string>,excerpt:struct<rendered:string>>>"
    p = responses.select(F.col(key).alias("response"), F.explode(F.from_json(column, one)).alias("p"))
    content = F.when(F.length("p.content.rendered") >= 100, F.col("p.content.rendered")).otherwise(F.coalesce("p.excerpt.rendered", "p.content.rendered"))
    return p.select("response", F.coalesce("p.link", "p.guid.rendered").alias("url"), F.col("p.title.rendered").alias("title"), content.alias("content"), F.try_to_timestamp("p.date").alias("published"))
