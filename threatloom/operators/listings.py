"""Article lists: filters, sorting, paging, lookups and gates, as column predicates over one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.text import domain, extraction_failed, garbage


def article_filter(
    articles: DataFrame,
    *,
    source: str | None = None,
    after: str | None = None,
    before: str | None = None,
    contains: str | None = None,
    sort_by: str = "discovered_at",
    descending: bool = True,
    offset: int = 0,
    limit: int | None = None,
    load_content: bool = True,
) -> DataFrame:
    """Articles by source, inclusive dates and a substring (case counts); ties in the order go to the larger id.

    Without content its length is kept instead, so a scan that doesn't search in it needs no text beyond that.
    """
    tests = [
        None if source is None else F.col("source") == source,
        None if after is None else F.col("discovered_at") >= F.lit(after).cast("timestamp_ntz"),
        None if before is None else F.col("discovered_at") <= F.lit(before).cast("timestamp_ntz"),
        None if contains is None else F.contains("content", F.lit(contains)),
    ]
    kept = articles.where(reduce(lambda a, b: a & b, (t for t in tests if t is not None), F.lit(True)))
    if not load_content:
        kept = kept.withColumn("char_length", F.length("content")).drop("content")
    column = F.col(sort_by)
    kept = kept.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), F.desc("article_id"))
    kept = kept.offset(offset) if offset else kept
    return kept if limit is None else kept.limit(limit)


def lookup(articles: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of a batch of ids; the list reaches the scan as a filter."""
    return articles.where(F.col("article_id").isin(ids))


def neighbours(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """For each id of ids the articles before and after it among all, by id. Ranges of ids meet their own articles only.

    Ids are dealt to ranges of WIDTH; a range carries the last id of the ranges before it and the first of those after.
    """
    width = 10_000
    keyed = articles.select("article_id", F.floor(F.col("article_id") / width).alias("r")).distinct()
    edges = keyed.groupBy("r").agg(F.min("article_id").alias("lo"), F.max("article_id").alias("hi"))
    order = Window.orderBy("r")  # one row for each range
    edges = edges.select("r", F.lag("hi").over(order).alias("below"), F.lead("lo").over(order).alias("above"))
    w = Window.partitionBy("r").orderBy("article_id")
    near = keyed.withColumns({"p": F.lag("article_id").over(w), "n": F.lead("article_id").over(w)}).join(edges, "r")
    near = near.select("article_id", F.coalesce("p", "below").alias("previous_id"), F.coalesce("n", "above").alias("next_id"))
    return ids.select("article_id").join(near, "article_id")


def without(articles: DataFrame, other: DataFrame) -> DataFrame:
    """Articles whose id stands in no row of other."""
    return articles.join(other.select("article_id").distinct(), "article_id", "left_anti")


def within(articles: DataFrame, other: DataFrame) -> DataFrame:
    return articles.join(other.select("article_id").distinct(), "article_id", "left_semi")


def first_reason(*tests: tuple[Column, str]) -> Column:
    """The name of the first test that fails a row, or 'ok'."""
    out = None
    for failed, name in tests:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise("ok")


def article_gate(articles: DataFrame, *, as_of: str, quality: Column, cost: Column) -> DataFrame:
    """Title 10 to 200 characters, content 100 to 50000, at most 365 days old, quality of 0.5, cost of 0.1."""
    title, content = F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("content", F.lit("")))
    age = F.datediff(F.lit(as_of).cast("timestamp_ntz"), F.col("discovered_at"))
    return articles.select(
        "article_id",
        first_reason(
            (title < 10, "title_too_short"), (title > 200, "title_too_long"), (content < 100, "content_too_short"), (content > 50_000, "content_too_long"),
            (age > 365, "too_old"), (quality < 0.5, "low_quality"), (cost > 0.1, "too_costly"),
        ).alias("reason"),
    )


def issues(articles: DataFrame, *, min_length: Column | int = 200) -> DataFrame:
    """All faults of title, content and, if there is one, url, in a fixed order (fixed values); min_length may differ by source."""
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    title, content, text = trimmed("title"), F.coalesce("content", F.lit("")), trimmed("content")
    some = text != ""
    every = [
        (title == "", "missing_title"),
        ((title != "") & (F.length(title) < 5), "short_title"),
        (F.length(title) > 500, "long_title"),
        (~some, "missing_content"),
        (some & garbage(content), "garbage"),
        (some & extraction_failed(content), "extraction_failed"),
        (some & content.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control_characters"),
        (some & F.contains(content, F.lit("\ufffd")), "broken_characters"),
        (some & (F.length(text) < min_length), "short_content"),
    ]
    if "url" in articles.columns:
        url = trimmed("url")
        every += [(url == "", "missing_url"), ((url != "") & ~F.rlike("url", F.lit("^https?://")), "invalid_url")]
    found = F.array_compact(F.array(*(F.when(test, name) for test, name in every)))
    return articles.select("article_id", F.array_join(found, ",").alias("issues"))


def url_scope(pages: DataFrame, domains: list[str], patterns: list[str]) -> DataFrame:
    """Whether an address lies in an allowed domain (substring of its host) and starts with one of the patterns."""
    host = domain(F.col("url"))
    allowed = reduce(lambda a, b: a | b, (F.contains(host, F.lit(d)) for d in domains)) if domains else F.lit(True)
    matched = reduce(lambda a, b: a | b, (F.col("url").rlike("^(?:" + p + ")") for p in patterns)) if patterns else F.lit(True)
    return pages.select("page_id", (allowed & matched).alias("in_scope"))


def due_sources(checks: DataFrame, *, as_of: str, frequency_seconds: int) -> DataFrame:
    """Sources whose last check lies at least frequency_seconds before as_of."""
    last = checks.groupBy("source_id").agg(F.max("check_time").alias("last_check"))
    age = F.timestamp_diff("SECOND", F.col("last_check"), F.lit(as_of).cast("timestamp_ntz"))
    return last.where(age >= frequency_seconds)


def eligible(articles: DataFrame, executions: DataFrame, score: Column, *, threshold: float) -> DataFrame:
    """Articles above the score threshold without an open ('O', 'P') or finished ('F') execution, as three counts and a verdict."""
    state = executions.groupBy("article_id").agg(F.count_if(F.col("status").isin("O", "P")).alias("open"), F.count_if(F.col("status") == "F").alias("finished"))
    rows = articles.select("article_id", score.alias("score")).join(state, "article_id", "left")
    verdict = first_reason((F.col("score") <= threshold, "below_threshold"), (F.coalesce("open", F.lit(0)) > 0, "running"), (F.coalesce("finished", F.lit(0)) > 0, "done"))
    return rows.select("article_id", verdict.alias("verdict"))


# Cues in a title by the kind of article, in the order in which they are tried.
TYPE_CUES = {
    "podcast": ("stormcast", "podcast", "episode"),
    "announcement": ("announcement", "update", "release", "bounty"),
    "analysis": ("analysis", "research", "investigation", "report"),
}


def content_type(articles: DataFrame) -> DataFrame:
    """The kind of an article by cues in its title, the first that fits."""
    t = F.lower(F.coalesce("title", F.lit("")))
    found = first_reason(*((reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words)), kind) for kind, words in TYPE_CUES.items()))
    return articles.select("article_id", F.when(found == "ok", "article").otherwise(found).alias("content_type"))


# Phrases of titles that tell of no threat, matched as plain text.
TITLE_PHRASES = (
    "job posting", "careers", "hiring", "we are hiring", "join our team", "press release", "gartner", "company news", "partnership announcement", "webinar", "event", "conference", "training", "workshop",
    "newsletter", "subscribe", "unsubscribe", "privacy policy", "terms of service", "cookie policy", "about us", "contact us", "advertisement", "sponsored", "promotion", "discount", "CFP Trackerproduct launch",
    "new product", "feature update", "maintenance", "downtime", "scheduled maintenance", "outage", "the state of", "office hours",
)


def title_blocked(articles: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """article_id, whether its title is blocked, and the first phrase that blocks it; an empty title is blocked without one."""
    title = F.lower(F.coalesce("title", F.lit("")))
    phrases = F.array(*map(F.lit, (*TITLE_PHRASES, *extra)))
    first = F.get(F.filter(phrases, lambda p: F.contains(title, p)), F.lit(0))
    return articles.select("article_id", ((title == "") | first.isNotNull()).alias("blocked"), first.alias("phrase"))


# Words that tell of a threat, in their order.
THREAT_WORDS = (
    "malware", "ransomware", "phishing", "apt", "attack", "vulnerability", "exploit", "breach", "campaign", "threat", "security", "incident", "botnet", "trojan", "backdoor", "spyware", "rootkit", "zero-day",
)


def enhanced(articles: DataFrame, *, as_of: str) -> DataFrame:
    """What is kept beside an article: threat words, day, month and year of publication, age in days, and of HTML its reading time, images, links and headings (ten)."""
    content = F.coalesce("content", F.lit(""))
    markup = F.contains(content, F.lit("<"))
    words = F.filter(F.array(*map(F.lit, THREAT_WORDS)), lambda w: F.contains(F.lower(content), w))
    count = lambda p: F.when(markup, F.regexp_count(content, F.lit("(?is)" + p)))
    headings = F.flatten(F.array(*(F.regexp_extract_all(content, F.lit(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>"), F.lit(1)) for n in range(1, 7))))
    plain = F.transform(F.slice(headings, 1, 10), lambda h: F.trim(F.regexp_replace(h, "<[^>]*>", "")))
    when = F.col("published_at")
    return articles.select(
        "article_id", words.alias("threat_words"), F.size(words).alias("threat_word_count"), F.date_format(when, "EEEE").alias("day_of_week"), F.date_format(when, "MMMM").alias("month"), F.year(when).alias("year"),
        F.floor(F.timestamp_diff("SECOND", when, F.lit(as_of).cast("timestamp_ntz")) / 86400).cast("int").alias("age_days"),
        F.when(markup, F.greatest(F.lit(1), F.floor(F.regexp_count(content, F.lit(r"\S+")) / 200))).cast("int").alias("reading_minutes"), count(r"<img\b").alias("images"), count(r"<a\b[^>]*\bhref\s*=").alias("links"), F.when(markup, plain).alias("headings"),
    )
