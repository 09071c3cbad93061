"""Addresses of articles from stored listing pages: links by selector or pattern, and a frontier that follows next pages.

Pages are rows (url, html) that were fetched before; an address without a stored page ends its path.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from threatloom.functions.text import normalize_url
from threatloom.session import written
from threatloom.sources.pages import VOID

LINK = "position int, href string, label string, target string"
STEP = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
# Pages that are followed from one listing, and how a page number stands in an address.
MOST_PAGES, PAGE_NUMBER = 3, r"[?&]p=(\d+)"


def parsed(selector: str) -> list[tuple[str, list[str], list[str]]]:
    """A selector of elements inside elements, each by tag, classes and id: `div.list a.post`."""
    steps = []
    for part in selector.split():
        found = STEP.fullmatch(part)
        if not found or not part:
            raise ValueError(f"can't read the selector {selector!r}")
        marks = re.findall(r"[.#][\w-]+", found[2])
        steps.append((found[1] or "", [m[1:] for m in marks if m[0] == "."], [m[1:] for m in marks if m[0] == "#"]))
    return steps


class LinkReader(HTMLParser):
    """Links (href, text) of a page whose element answers the selector's last step inside elements that answer the ones before."""

    def __init__(self, selector: str):
        super().__init__(convert_charrefs=True)
        self.steps = parsed(selector)
        self.stack: list[tuple[str, int]] = []  # tag, and how many steps are answered down to it
        self.links: list[list[str]] = []
        self.open: list[tuple[int, int]] = []  # the depth of an open link and its number

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        attrs = {k: v or "" for k, v in attributes}
        classes = attrs.get("class", "").split()
        done = self.stack[-1][1] if self.stack else 0

        def answers(step: tuple[str, list[str], list[str]]) -> bool:
            name, has, ids = step
            return name in ("", tag) and set(has) <= set(classes) and all(attrs.get("id") == i for i in ids)

        if tag == "a" and attrs.get("href") and self.steps and done >= len(self.steps) - 1 and answers(self.steps[-1]):
            self.links.append([attrs["href"], ""])
            self.open.append((len(self.stack), len(self.links) - 1))
        if tag not in VOID:
            self.stack.append((tag, done + (done < len(self.steps) - 1 and answers(self.steps[done]))))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            del self.stack[at:]
            self.open = [o for o in self.open if o[0] < at]

    def handle_data(self, data: str) -> None:
        for _, number in self.open:
            self.links[number][1] += data


@udtf(returnType=LINK)
class PageLinks:
    def eval(self, url: str, html: str, selector: str):
        reader = LinkReader(selector)
        reader.feed(html or "")
        for position, (href, label) in enumerate(reader.links):
            try:
                target = urljoin(url or "", href)
            except ValueError:  # an address that can't be read
                continue
            yield position, href, " ".join(label.split()), target


def links(pages: DataFrame, selector: str = "a") -> DataFrame:
    """A row for each link of each page: the page's columns, position, href, label, target and address (the target's normal form)."""
    found = pages.lateralJoin(PageLinks(F.col("url").outer(), F.col("html").outer(), F.lit(selector)))
    return found.drop("html").withColumn("address", normalize_url(F.col("target")))


def by_pattern(pages: DataFrame, patterns: list[str]) -> DataFrame:
    """url and address of links whose address begins with a match of one of the patterns, each once."""
    fits = F.rlike("address", F.lit("|".join(f"^(?:{p})" for p in patterns))) if patterns else F.lit(False)
    return links(pages).where(fits).select("url", "address").distinct()


def page_number(url: Column) -> Column:
    return F.regexp_extract(url, PAGE_NUMBER, 1).try_cast("long")


def next_pages(found: DataFrame, frontier: DataFrame) -> DataFrame:
    """listing and url of the next page of each frontier page: its first next link, else the page number and one.

    A link is a next one if it says so, or if it is a number; if it has a page number, that must be larger than the page's own.
    """
    own, their = page_number(F.col("url")), page_number(F.col("href"))
    label = F.lower("label")
    says = F.contains(label, F.lit("next"))
    ahead = F.when(their.isNotNull(), (says | F.rlike(label, F.lit(r"^\d+$"))) & (own.isNull() | (their > own))).otherwise(says)
    first = found.where(ahead).groupBy("listing", "url").agg(F.min_by("target", "position").alias("target"))
    base = F.regexp_replace(F.col("url"), r"[?&]p=\d+", "")
    counted = F.when(own.isNotNull(), F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("p="), (own + 1).cast("string")))
    rows = frontier.join(first, ["listing", "url"], "left").select("listing", F.coalesce("target", counted).alias("url"))
    return rows.where("url IS NOT NULL")


def discover(pages: DataFrame, listings: DataFrame, post_selector: str, next_selector: str = "", *, most_pages: int = MOST_PAGES) -> DataFrame:
    """listing and address of every article that is linked from a listing (url) or from the pages that follow it, each once.

    Each round joins the frontier with the stored pages and goes on with next pages that weren't seen from that listing; after
    most_pages rounds, or with an empty frontier, it ends.
    """
    frontier = written(listings.select(F.col("url").alias("listing"), "url").distinct(), "frontier")
    seen, posts = frontier, None
    for page in range(most_pages):
        here = frontier.join(pages.select("url", "html"), "url")
        found = links(here, post_selector).select("listing", "address")
        posts = found if posts is None else posts.unionByName(found)
        if not next_selector or page == most_pages - 1:
            break
        onward = next_pages(links(here, next_selector), here.select("listing", "url").distinct()).distinct()
        frontier = written(onward.join(seen, ["listing", "url"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return posts.distinct()
