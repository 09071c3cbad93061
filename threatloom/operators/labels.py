"""Classification of texts and observables by weighted tokens and precedence rules, in each row alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.text import KEYWORDS, hits, hunt_score

# Words that raise the quality of an article.
TECHNICAL = ("malware", "threat", "attack", "exploit", "vulnerability", "security")
# The telemetry of each kind of observable; other kinds stand for themselves.
TELEMETRY = {
    "cmdline": "process_creation",
    "process_lineage": "process_creation",
    "hunt_queries": "hunt_query",
    "registry_artifacts": "registry",
    "windows_services": "service_creation",
    "scheduled_tasks": "scheduled_task",
    "network_indicators": "network_connection",
}
# Kinds that only Windows has.
WINDOWS_ONLY = ("registry_artifacts", "windows_services", "scheduled_tasks")


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def lookup(column: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """The value of a key, else the default."""
    found = F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), column)
    return found if default is None else F.coalesce(found, default)


def keyword_verdict(text: Column, registry: dict[str, list[str]] = KEYWORDS) -> tuple[Column, Column]:
    """Whether a text has more positive than negative keywords, and how sure that is.

    The confidence is the keyword score over 100; without a score it is the larger share of the two kinds, 0 without any keyword.
    A positive text is at least 0.1 sure (fixed value).
    """
    count = {tier: total([h.cast("int") for h in hits(text, words)]) for tier, words in registry.items()}
    positive, negative = total([n for tier, n in count.items() if tier != "negative"]), count.get("negative", F.lit(0))
    score = hunt_score(text, registry)
    share = F.coalesce(F.try_divide(F.greatest(positive, negative).cast("double"), positive + negative), F.lit(0.0))
    sure = F.when(score > 0, F.least(F.lit(1.0), score / 100)).otherwise(share)
    return positive > negative, F.when((positive > negative) & (sure == 0), 0.1).otherwise(sure)


def quality_score(title: Column, content: Column, authors: Column, tags: Column) -> Column:
    """Points for length, title, technical words, authors (whether there are any) and tags, 1 at most."""
    text, heading = F.coalesce(content, F.lit("")), F.coalesce(title, F.lit(""))
    n = F.length(text)
    words = total([F.contains(F.lower(text), F.lit(w)).cast("int") for w in TECHNICAL])
    points = [
        F.when(n > 500, 20).when(n > 200, 10).otherwise(5),
        F.when(F.length(heading) > 20, 10).otherwise(5),
        F.least(F.lit(30), words * 5),
        F.when(n > 10_000, 20).otherwise(0),
        F.when(authors, 10).otherwise(5),
        F.when(tags, 10).otherwise(5),
    ]
    return F.least(F.lit(100), total(points)) / 100


def cost_estimate(content: Column, authors: Column, tags: Column) -> Column:
    """A hundred-thousandth for each character and a hundredth each for authors and tags, 1 at most."""
    units = F.coalesce(F.length(content), F.lit(0)) + F.when(authors, 1000).otherwise(0) + F.when(tags, 1000).otherwise(0)
    return F.least(F.lit(100_000), units) / 100_000


def dimension_labels(text: Column, entries: list[tuple[str, int, list[str]]], labels: list[str], *, floor: int = 2) -> Column:
    """Every label whose tokens in the text weigh floor or more, by weight, then in the order of labels."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    weight = lambda label: total([F.when(F.contains(lowered, F.lit(t.lower())), w).otherwise(0) for t, w, of in entries if label in of])
    scored = F.array(*(F.struct((-weight(label)).alias("w"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, label in enumerate(labels)))
    return F.transform(F.array_sort(F.filter(scored, lambda x: x["w"] <= -floor)), lambda x: x["label"])


def products(rows: DataFrame, key: str, text: Column, tokens: dict[str, list[str]]) -> DataFrame:
    """One row for each product that a text names, with the tokens that show it, in their order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    shown = lambda ts: F.array_compact(F.array(*(F.when(F.contains(lowered, F.lit(t.lower())), t) for t in ts)))
    found = F.array(*(F.struct(F.lit(name).alias("product"), shown(ts).alias("evidence")) for name, ts in tokens.items()))
    return rows.select(key, F.explode(F.filter(found, lambda p: F.size(p["evidence"]) > 0)).alias("p")).select(key, "p.product", "p.evidence")


def observable_metadata(rows: DataFrame, *, kind: Column, platform: Column, article_platforms: Column) -> DataFrame:
    """Platform, its confidence, telemetry, logsource and whether a rule can be written, beside the columns of rows.

    An observable's own platform comes first, then a kind that only Windows has, then the one concrete platform of its article.
    """
    concrete = F.filter(article_platforms, lambda p: p.isin("windows", "linux", "macos"))
    own = F.lower(F.trim(platform))
    known = own.isin("windows", "linux", "macos")
    windows = kind.isin(*WINDOWS_ONLY)
    single = F.size(concrete) == 1
    cross = (F.size(article_platforms) == 1) & (F.element_at(article_platforms, 1) == "cross-platform")
    chosen = F.when(known, own).when(windows, "windows").when(single, F.try_element_at(concrete, F.lit(1))).when(cross, "cross-platform").otherwise("unknown")
    sure = F.when(known | windows, "high").when(single | cross, "medium").otherwise("low")
    out = rows.withColumns({"platform": chosen, "platform_confidence": sure, "telemetry": lookup(kind, TELEMETRY, kind)})
    p, t = F.col("platform"), F.col("telemetry")
    both = p.isin("windows", "linux")
    source = (
        F.when((t == "process_creation") & both, F.concat_ws("/", p, t))
        .when(t == "network_connection", F.when(both, F.concat_ws("/", p, t)).otherwise(t))
        .when(t == "registry", "windows/registry_event")
        .when(t.isin("service_creation", "scheduled_task"), F.concat(F.lit("windows/"), t))
    )
    return out.withColumn("logsource", source).withColumn("eligible", F.col("logsource").isNotNull() & p.isin("windows", "linux", "unknown", "cross-platform"))


def system_label(rows: DataFrame, *, known: Column, platforms: Column, windows_words: Column, floor: int = 3) -> Column:
    """A system known before, else the first platform by weight, else Windows if it has floor words or more, else unknown."""
    return F.coalesce(known, F.try_element_at(platforms, F.lit(1)), F.when(windows_words >= floor, "windows"), F.lit("unknown"))


def adjudication(response: Column, aliases: dict[str, str]) -> tuple[Column, Column]:
    """Platforms and confidence out of the JSON in an answer: a fenced block, else from the first brace to the last.

    Names become platforms through aliases, each once, in their order; an unknown confidence is medium, no platform low.
    """
    text = F.trim(F.coalesce(response, F.lit("")))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    raw = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    data = F.from_json(raw, "platforms array<string>, confidence string")
    names = F.transform(F.coalesce(data["platforms"], F.array().cast("array<string>")), lambda p: lookup(F.lower(F.trim(p)), aliases))
    found = F.array_distinct(F.array_compact(names))
    stated = F.lower(F.trim(data["confidence"]))
    return found, F.when(F.size(found) == 0, "low").when(stated.isin("high", "medium", "low"), stated).otherwise("medium")


def stage_reached(
    *, supported: Column, junk: Column, rank: Column, threshold: float, bypass: Column, items: Column, rules: Column, best: Column, known: float, inconclusive: Column
) -> Column:
    """The stage at which the chain of checks ends for an article: the first that fails, or its rules are queued."""
    return (
        F.when(~supported, "platform")
        .when(junk, "junk")
        .when(~bypass & (F.coalesce(rank, F.lit(0.0)) < threshold), "rank")
        .when(items == 0, "extract")
        .when(rules == 0, "rules")
        .when((F.coalesce(best, F.lit(0.0)) >= known) & ~inconclusive, "similarity")
        .otherwise("queued")
    )


def trimmed_lines(content: Column, *, start: list[str], banner: list[str], footer: list[str], least: int = 100) -> Column:
    """Lines from the first that has a start word (in any case) up to the first with a footer phrase.

    Empty lines go; a banner line before the start never ends the text. A result under least characters gives the content back.
    """
    lines = F.filter(F.transform(F.split(content, "\n"), lambda s: F.btrim(s, F.lit(" \t\x0b\f\r"))), lambda s: s != "")
    has = lambda s, words: reduce(lambda a, b: a | b, (F.contains(s, F.lit(w)) for w in words), F.lit(False))
    # As the only element of an array, what several expressions use is computed once.
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def cut(lines: Column, first: Column) -> Column:
        ended_before = F.exists(F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0))), lambda s: has(s, footer) & ~has(s, banner))

        def ended(tail: Column) -> Column:
            end = F.array_position(F.transform(tail, lambda s: has(s, footer)), F.lit(True)).cast("int")
            return once(end, lambda end: F.array_join(F.slice(tail, F.lit(1), F.when(end == 0, F.size(tail)).otherwise(end - 1)), "\n\n"))

        return F.when((first == 0) | ended_before, "").otherwise(once(F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines)), ended))

    def started(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda s: has(F.lower(s), start)), F.lit(True)).cast("int")
        return once(first, lambda first: cut(lines, first))

    return once(once(lines, started), lambda kept: F.when(F.length(F.trim(kept)) < least, content).otherwise(kept))


def author_names(authors: Column, *, most: int = 5) -> Column:
    """Names without a leading `by` or `author:` and a closing role, of 3 to 99 characters; the first of them."""
    plain = lambda a: F.regexp_replace(F.trim(F.regexp_replace(a, r"\s+", " ")), r"(?i)^(by|author:?)\s+", "")
    names = F.transform(authors, lambda a: F.regexp_replace(plain(a), r"(?i)\s+(writer|author)$", ""))
    return F.slice(F.filter(names, lambda a: (F.length(a) > 2) & (F.length(a) < 100)), 1, most)


def tag_names(tags: Column, *, most: int = 10) -> Column:
    """Distinct tags in lower case, of 2 to 50 characters, without other signs than hyphens and underscores, in order."""
    plain = F.filter(F.transform(tags, lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))), lambda t: F.length(t).between(2, 50))
    words = F.filter(F.transform(plain, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_\s-]", "")), lambda t: t != "")
    return F.slice(F.array_sort(F.array_distinct(words)), 1, most)


def atom_text(atom: Column) -> Column:
    """`field|modifiers|value` as `field|first modifier:value`, as `field:value` without a modifier; other strings unchanged."""
    parts = F.split(atom, r"\|")
    field, value = F.element_at(parts, 1), F.element_at(parts, -1)
    operator = F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(2))).otherwise("")
    return F.when(F.size(parts) < 2, atom).when(operator != "", F.concat(field, F.lit("|"), operator, F.lit(":"), value)).otherwise(F.concat(field, F.lit(":"), value))
