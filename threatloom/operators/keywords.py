"""Keywords of a registry in texts: their places, which of overlapping ones count, and how they are shown.

A registry is a table (position, match, tier, platforms, weight), read from a YAML file or given as tiers of words. One pass
over each text finds the words that stand in it at all (Aho-Corasick), places those by their patterns and settles each cluster (island of
overlapping spans) as soon as it is complete: winners don't overlap. They stay beside their text as an array, in which neighbours of one category
merge; so neither spans nor texts are shuffled or sorted, and a task holds one Arrow batch, whatever the table's size.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.text import PARTIAL, PREFIXES, literal, word_pattern
from threatloom.session import map_rows

# The categories by precedence, with their display names.
CATEGORIES = {"perfect": "Perfect", "good": "Good", "lolbas": "LOLBAS", "intelligence": "Intelligence", "negative": "Negative"}
#: A registry with more words than this is no configuration any more, and isn't sent to the tasks.
MOST_WORDS = 50_000
REGISTRY = "position int, match string, tier string, platforms array<string>, weight int"
RAW = "article_id long, start int, end int, keyword string, category string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a YAML file with a list `keywords` (match, and tier or platforms with a weight), in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = yaml.safe_load(text) or {}
                entries = data.get("keywords") if isinstance(data, dict) else None
                if not isinstance(entries, list):
                    raise ValueError("the keyword registry has no list of keywords")
                rows = [{"position": i, "match": str(e["match"]), "tier": e.get("tier"), "platforms": e.get("platforms"), "weight": int(e.get("weight", 1))} for i, e in enumerate(entries)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("position", pa.int32()), ("match", pa.string()), ("tier", pa.string()), ("platforms", pa.list_(pa.string())), ("weight", pa.int32())]))

    return spark.read.text(path, wholetext=True).mapInArrow(run, REGISTRY)


def words_by_tier(registry: DataFrame) -> dict[str, list[str]]:
    """The hunt-scoring projection: the words of each tier in their order. Unknown tiers are an error."""
    rows = registry.where("tier IS NOT NULL").orderBy("position").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a registry holds {MOST_WORDS} words at most")
    if unknown := {r.tier for r in rows} - CATEGORIES.keys():
        raise ValueError(f"unknown tiers: {sorted(unknown)}")
    return {tier: [r.match for r in rows if r.tier == tier] for tier in CATEGORIES}


def platform_weights(registry: DataFrame) -> dict[str, dict[str, int]]:
    """The platform projection: the weight of each word, by platform."""
    out: dict[str, dict[str, int]] = {}
    for r in registry.where("size(platforms) > 0").orderBy("position").limit(MOST_WORDS).collect():
        for platform in r.platforms:
            out.setdefault(platform, {})[r.match.lower()] = r.weight
    return out


def span_pattern(word: str) -> str:
    """The pattern of a word's places: as for scoring, but edges are letters only, so that digits and _ may stand beside it."""
    if word.lower() in (*PARTIAL, ".exe"):
        return re.escape(word)
    pattern = word_pattern(word)
    if word.lower() in PREFIXES:
        return pattern
    if pattern.startswith(r"\b"):
        pattern = "(?<![a-zA-Z])" + pattern[2:]
    return pattern.replace(r"\b", "(?![a-zA-Z])")


class Finder:
    """The places of a registry's words in a text: (start, end, keyword, category)."""

    def __init__(self, registry: dict[str, list[str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.by_literal: dict[str, list[tuple]] = {}
        for tier, words in registry.items():
            for word in filter(None, words):
                self.by_literal.setdefault(literal(word), []).append((re.compile(span_pattern(word), re.IGNORECASE), word, tier))
        for name in self.by_literal:
            self.automaton.add_word(name, name)
        if self.by_literal:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple]:
        if not text or not self.by_literal:
            return []
        stand = {name for _, name in self.automaton.iter(text.lower())}
        return [(m.start(), m.end(), word, tier) for name in stand for pattern, word, tier in self.by_literal[name] for m in pattern.finditer(text)]


def raw_spans(articles: DataFrame, registry: dict[str, list[str]]) -> DataFrame:
    """Every place of every word: article_id, start (code points, from 0), end, keyword, category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(registry)
        for batch in batches:
            out = [(article_id, *span) for article_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for span in find(text)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["article_id", "start", "end", "keyword", "category"])

    return map_rows(articles.select(F.col("article_id").cast("long").alias("article_id"), "content"), run, RAW)


def clusters(spans: list[tuple]) -> Iterator[list[tuple]]:
    """Islands of a text's overlapping spans: a span that begins before the furthest end so far belongs to the same one."""
    island: list[tuple] = []
    end = -1
    for span in sorted(spans, key=lambda s: (s[0], s[1])):
        if island and end <= span[0]:
            yield island
            island = []
        island.append(span)
        end = max(end, span[1])
    if island:
        yield island


def precedence(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category)


def winning(spans: list[tuple]) -> list[tuple]:
    """Of one cluster, in the order of display (perfect words, then the longest), each span that overlaps none taken before it.

    Each (start, end, category) comes with how many spans of each category overlap it.
    """
    if len(spans) == 1:
        ((begin, end, _, category),) = spans
        return [(begin, end, category, {category: 1})]
    rank = {c: i for i, c in enumerate(CATEGORIES)}
    shown = sorted(spans, key=lambda s: (s[3] != "perfect", 0 if s[3] == "perfect" else s[0] - s[1], rank[s[3]], s[0], s[2].lower()))
    starts: list[int] = []
    taken: dict[int, tuple] = {}
    for s in shown:
        at = bisect_left(starts, s[1])  # taken spans don't overlap, so only the last that begins before this one's end can
        if not at or taken[starts[at - 1]][1] <= s[0]:
            starts.insert(at, s[0])
            taken[s[0]] = s
    edges = {c: (sorted(s[0] for s in spans if s[3] == c), sorted(s[1] for s in spans if s[3] == c)) for c in {s[3] for s in spans}}
    out = []
    for begin in starts:
        _, end, _, category = taken[begin]
        counts = {c: bisect_left(a, end) - bisect_right(z, begin) for c, (a, z) in edges.items()}
        out.append((begin, end, category, {c: n for c, n in counts.items() if n}))
    return out


WINNERS = "array<struct<start:int,end:int,category:string,counts:array<struct<category:string,n:int>>>>"


def winners(articles: DataFrame, registry: dict[str, list[str]]) -> DataFrame:
    """article_id, content and won: the spans that count in each text, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(registry)
        count = pa.list_(pa.struct([("category", pa.string()), ("n", pa.int32())]))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("counts", count)]))
        for batch in batches:
            won = [[{"start": a, "end": z, "category": c, "counts": [{"category": k, "n": n} for k, n in counts.items()]} for island in clusters(find(text)) for a, z, c, counts in winning(island)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(won, kind)], names=["article_id", "content", "won"])

    return map_rows(articles.select(F.col("article_id").cast("long").alias("article_id"), "content"), run, f"article_id long, content string, won {WINNERS}")


def marked(articles: DataFrame, registry: dict[str, list[str]]) -> DataFrame:
    """article_id, content and spans: those to be shown in each text, in their order, as resolved() has them."""
    n = F.size("won")
    before = lambda i: F.element_at("won", i - 1)
    follows = lambda x, i: (before(i)["end"] == x["start"]) & (before(i)["category"] == x["category"])
    # Numbers from 1 on of the spans that open an island of neighbours; an island ends before the next one opens.
    opens = F.filter(F.transform("won", lambda x, i: F.when((i > 0) & F.coalesce(follows(x, F.greatest(i + 1, F.lit(2))), F.lit(False)), 0).otherwise(i + 1)), lambda i: i > 0)
    opened = winners(articles, registry).withColumn("opens", opens)
    ends = F.concat(F.slice("opens", F.lit(2), F.greatest(F.size("opens"), F.lit(1))), F.array(n + 1))
    islands = F.zip_with("opens", F.when(n > 0, ends).otherwise(F.array().cast("array<int>")), lambda a, z: F.slice("won", a, z - a))
    parted = opened.select("article_id", "content", islands.alias("islands"))

    def span(x: Column) -> Column:
        sources, counts = _tallied(F.flatten(x["counts"]))
        return F.struct(x[0]["start"].alias("start"), F.element_at(x, -1)["end"].alias("end"), x[0]["category"].alias("category"), sources, counts)

    return parted.select("article_id", "content", F.transform("islands", span).alias("spans"))


def resolved(articles: DataFrame, registry: dict[str, list[str]]) -> DataFrame:
    """The spans to be shown: article_id, start, end, category, sources (by precedence) and counts (by name of category)."""
    return marked(articles, registry).select("article_id", F.inline("spans"))


def _tallied(parts: str | Column) -> tuple[Column, Column]:
    """The categories of the parts by precedence, and their sums by name."""
    names = F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["category"])))
    total = lambda c: F.aggregate(F.filter(parts, lambda p: p["category"] == c), F.lit(0), lambda a, p: a + p["n"])
    return (
        F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.array_contains(names, c)).alias("sources"),
        F.transform(names, lambda c: F.struct(c.alias("category"), total(c).alias("n"))).alias("counts"),
    )


def title(category: Column, sources: Column) -> Column:
    """The tool tip of a shown span."""
    shown = lambda c: F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[c]
    others = F.array_join(F.transform(sources, shown), ", ")
    how = F.when(category == sources[0], " | Highest-priority match among: ").otherwise(" | More-specific match among: ")
    return F.concat(F.lit("Category: "), shown(category), F.when(F.size(sources) == 1, "").otherwise(F.concat(how, others)))


def panel_items(articles: DataFrame, spans: DataFrame) -> DataFrame:
    """Shown spans by category and text without regard to case: the first text, sources, counts and title."""
    joined = spans.join(articles.select(F.col("article_id").cast("long").alias("article_id"), "content"), "article_id")
    return _panel(joined.select("article_id", "start", "category", "counts", _shown(F.col("content"), F.col("start"), F.col("end")).alias("text")))


def panel(articles: DataFrame, registry: dict[str, list[str]]) -> DataFrame:
    """panel_items() of the registry's words: each text's spans lie beside it, so that no text is shuffled."""
    cut = lambda x: F.struct(x["start"].alias("start"), x["category"].alias("category"), x["counts"].alias("counts"), _shown(F.col("content"), x["start"], x["end"]).alias("text"))
    return _panel(marked(articles, registry).select("article_id", F.inline(F.transform("spans", cut))))


def _shown(content: Column, start: Column, end: Column) -> Column:
    return F.trim(F.substring(content, start + 1, end - start))


def _panel(rows: DataFrame) -> DataFrame:
    text = rows.where("text <> ''")
    grouped = text.groupBy("article_id", "category", F.lower("text").alias("key")).agg(F.min_by("text", "start").alias("text"), F.min("start").alias("first"), F.flatten(F.collect_list("counts")).alias("parts"))
    tallied = grouped.select("article_id", "category", "text", "first", *_tallied("parts"))
    return tallied.withColumn("title", title(F.col("category"), F.col("sources")))


def highlighted(articles: DataFrame, spans: DataFrame, *, classes: dict[str, str] | None = None) -> DataFrame:
    """article_id and its content as HTML, with each shown span in an element of its own."""
    listed = spans.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "category", F.array_join("sources", ",").alias("sources"), title(F.col("category"), F.col("sources")).alias("title")))).alias("spans"))
    both = articles.select(F.col("article_id").cast("long").alias("article_id"), "content").join(listed, "article_id", "left")
    return _html(both, classes)


def highlights(articles: DataFrame, registry: dict[str, list[str]], *, classes: dict[str, str] | None = None) -> DataFrame:
    """highlighted() with the registry's words: each text's spans lie beside it, so that no text is shuffled."""
    named = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["category"].alias("category"), F.array_join(x["sources"], ",").alias("sources"), title(x["category"], x["sources"]).alias("title"))
    return _html(marked(articles, registry).select("article_id", "content", F.transform("spans", named).alias("spans")), classes)


def _html(rows: DataFrame, classes: dict[str, str] | None) -> DataFrame:
    styles = {c: f" {(classes or {}).get(c, '')}".rstrip() for c in CATEGORIES}

    def shown(text: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in spans:
            name = s["category"]
            out.append(html.escape(text[at : s["start"]]))
            out.append(
                f'<span class="keyword-highlight keyword-highlight--{name}{styles[name]}" data-keyword-category="{name}"'
                f' data-source-categories="{s["sources"]}" title="{html.escape(s["title"])}">{html.escape(text[s["start"] : s["end"]])}</span>'
            )
            at = s["end"]
        return "".join([*out, html.escape(text[at:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shown(t or "", s or []) for t, s in zip(texts, spans, strict=True)], pa.string())], names=["article_id", "html"])

    return map_rows(rows, run, "article_id long, html string")
