"""Text, hash and score expressions, all as Column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the keyword score by tier.
TIER_WEIGHTS = {"perfect": 75.0, "good": 5.0, "lolbas": 10.0, "intelligence": 10.0, "negative": -15.0}
#: A small registry for reports over the synthetic documents; real ones are read from a file or passed in.
KEYWORDS = {
    "perfect": ["token", "general public license"],
    "good": ["licensed under", "version", "|"],
    "lolbas": ["released under", ".com"],
    "intelligence": ["apache", "mit license", "cc by-nc"],
    "negative": ["idiot", "trash", "stupid"],
}


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


def keep_newlines(c: Column) -> Column:
    """Collapses blanks inside lines and leaves at most one empty line between paragraphs."""
    c = F.regexp_replace(c, r"[ \t\f\x0B\r]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def ascii_clean(c: Column) -> Column:
    """Drops control characters; every other run outside ASCII becomes one space."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return collapse_whitespace(F.regexp_replace(c, r"[^\x00-\x7F]+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


# Keywords that match inside words, before any ending, or as symbols, and keywords that are patterns themselves.
PARTIAL = ("hunting", "detection", "monitor", "alert", "executable", "parent-child", "defender query")
PREFIXES = ("spawn",)
SYMBOLS = ("==", "!=", "<=", ">=", "::", "-->", "->", "//", "--", "\\", "|", "C:\\", "D:\\")
OBFUSCATION = (
    r"%[A-Za-z0-9_]+:~[0-9]+(,[0-9]+)?%",
    r"%[A-Za-z0-9_]+:[^=%%]+=[^%]*%",
    r"![A-Za-z0-9_]+!",
    r"\bcmd(\.exe)?\s*/V(?::[^ \t/]+)?",
    r"\bset\s+[A-Za-z0-9_]+\s*=",
    r"\bcall\s+(set|%[A-Za-z0-9_]+%|![A-Za-z0-9_]+!)",
    r"(%[^%]+%){4,}",
    r"\bfor\s+/?[A-Za-z]*\s+%[A-Za-z]\s+in\s*\(",
    r"![A-Za-z0-9_]+:~%[A-Za-z],1!",
    r"\bfor\s+/L\s+%[A-Za-z]\s+in\s*\([^)]+\)",
    r"%[A-Za-z0-9_]+:~-[0-9]+%|%[A-Za-z0-9_]+:~[0-9]+%",
    r"%[A-Za-z0-9_]+:\*[^!%]+=!%",
    r"[^\w](s\^+e\^*t|s\^*e\^+t)[^\w]",
    r"[^\w](c\^+a\^*l\^*l|c\^*a\^+l\^*l|c\^*a\^*l\^+l)[^\w]",
    r"[^\w]([a-z]\^+[a-z](\^+[a-z])*)[^\w]",
    r"%[^%]+%<[^>]*|set\s+[A-Za-z0-9_]+\s*=\s*[^&|>]*\|",
)


def keyword_pattern(word: str) -> str:
    """The pattern by which a keyword of a registry is looked for, without regard to case."""
    return word if word in OBFUSCATION else word_pattern(word)


def word_pattern(word: str) -> str:
    """The pattern of a keyword that is no pattern itself."""
    plain = re.escape(word)
    if word.lower() in PARTIAL or word in SYMBOLS:
        return plain
    if word.lower() in PREFIXES:
        return plain + r"\w*"
    if word.startswith("-") or word.endswith("-"):
        return rf"(?<![a-zA-Z]){plain}(?![a-zA-Z])"
    if word.startswith("."):
        return rf"[a-zA-Z0-9_]{plain}\b"
    if word.endswith((".exe", ".dll")):
        base, ending = re.escape(word[:-4]), word[-3:]
        if len(word) <= 7:
            return rf"\b{base}(\.{ending}\b|(?![a-zA-Z0-9]))"
        return rf"\b{base}\.exe\b" if ending == "exe" else rf"\b{base}(\.dll)?\b"
    return rf"\b{plain}\b"


def literal(word: str) -> str:
    """What stands in the lower-cased text wherever the pattern of a keyword (that is no pattern itself) matches."""
    return word[:-4].lower() if word.endswith((".exe", ".dll")) and len(word) > 4 else word.lower()


def hits(text: Column, words: list[str]) -> list[Column]:
    """Whether each keyword stands in the text by its pattern; the pattern is only tried where its literal stands."""
    whole = F.coalesce(text, F.lit(""))
    by_pattern = lambda w: F.rlike(whole, F.lit("(?iuU)" + keyword_pattern(w)))
    return [by_pattern(w) if w in OBFUSCATION else F.contains(F.lower(whole), F.lit(literal(w))) & by_pattern(w) for w in words]


def matches(text: Column, words: list[str]) -> Column:
    """The keywords that stand in the text, in their order."""
    return F.array_compact(F.array(*(F.when(h, F.lit(w)) for h, w in zip(hits(text, words), words, strict=True))))


def keyword_score(counts: dict[str, Column]) -> Column:
    """Each tier saturates by halves; the sum is held between 0 and 99.9 and rounded to a tenth."""
    parts = [F.lit(weight) * (1 - F.pow(F.lit(0.5), counts[tier].cast("double"))) for tier, weight in TIER_WEIGHTS.items() if tier in counts]
    total = reduce(lambda a, b: a + b, parts)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(99.9), total)), 1)


def hunt_score(text: Column, registry: dict[str, list[str]] = KEYWORDS) -> Column:
    """The keyword score; hits are added up without an array of the words."""
    return keyword_score({tier: reduce(lambda a, b: a + b, (h.cast("int") for h in hits(text, words)), F.lit(0)) for tier, words in registry.items()})


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


# Query parameters that only track visits.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "_ga", "_gid", "mc_cid", "mc_eid",
    "si", "s", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref", "campaign", "email", "newsletter", "social", "share", "click",
]


def normalize_url(url: Column, tracking: list[str] = TRACKING) -> Column:
    """Lower case, without closing slashes, tracking parameters, parameters without `=`, fragment and a leading www."""
    plain = F.regexp_replace(F.trim(url), r"/+$", "")
    base, query = F.substring_index(plain, "?", 1), F.regexp_extract(plain, r"(?s)\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: F.contains(p, F.lit("=")) & ~F.lower(F.substring_index(p, "=", 1)).isin(tracking))
    whole = F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
    return F.regexp_replace(F.lower(F.substring_index(whole, "#", 1)), r"^www\.", "")


# How dates are written in addresses, in the order in which they are tried.
URL_DATES = (r"(\d{4})/(\d{1,2})/(\d{1,2})", r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})(\d{2})(\d{2})")


def url_date(url: Column) -> Column:
    """The first valid date written as 2024/01/31, 2024-01-31 or 20240131."""
    parts = lambda p: F.concat_ws("-", F.regexp_extract(url, p, 1), *(F.lpad(F.regexp_extract(url, p, g), 2, "0") for g in (2, 3)))
    return F.coalesce(*(F.try_to_date(parts(p), "yyyy-MM-dd") for p in URL_DATES))


def garbage_ratio(c: Column) -> Column:
    """Share of bracket, bar and backslash characters."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, r"[^\[\]{}|\\]", "")), F.length(c)), F.lit(0.0))


# Texts and phrases of content that wasn't read right, and runs of characters that no text has.
GARBAGE_TEXTS = ("`E9 UI=", "cwCz _9hvtYfL", "\ufffd")
GARBAGE_PHRASES = ("compression issues", "website compression", "content extraction failed", "failed due to website", "compression failed", "extraction disabled")
FAILURE_PHRASES = (
    "content extraction failed", "failed due to website compression", "extraction is disabled", "please visit the original article", "compression issues", "website compression issues", "full content extraction is disabled",
)
GARBAGE_RUNS = (
    r"[\[\]{}|\\]{5,}",
    r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xFF]{10,}",
    r"[^\w\s\.\,\;\:\!\?\(\)\-\+\=\<\>\/\"\'\[\]\{\}\|\\\~\#\$\%\^\&\*\_\`\@]{15,}",
    r"[\x00-\x08\x0B\x0C\x0E-\x1F]",
)


def garbage(c: Column) -> Column:
    """Whether a content is no text: brackets, runs of odd characters, control characters, or a note that reading it failed."""
    c = F.coalesce(c, F.lit(""))
    texts = [F.contains(c, F.lit(t)) for t in GARBAGE_TEXTS] + [F.contains(F.lower(c), F.lit(p)) for p in GARBAGE_PHRASES]
    return reduce(lambda a, b: a | b, texts, (garbage_ratio(c) > 0.15) | F.rlike(c, F.lit("(?U)" + "|".join(GARBAGE_RUNS))))


def extraction_failed(c: Column) -> Column:
    """Whether a content says that it couldn't be read."""
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p)) for p in FAILURE_PHRASES))


# What is masked in detection values, in this order.
MASKS = (
    (r"(?i:([a-zA-Z]:\\|\\\\[^\\]+\\|%[^%]+%\\).*?(\\(?:[^\\\s]+|[*?])+)?)", "<path>"),
    (r"/(?:usr|etc|var|tmp|home|opt|root|[~$])(?:/[^\s\*]+)*(?:/\*|\?)?", "<path>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"\b([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\b", "<ip>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b[0-9a-fA-F]{32}\b", "<hash>"),
    (r"\b[0-9a-fA-F]{40}\b", "<hash>"),
    (r"\b[0-9a-fA-F]{64}\b", "<hash>"),
)


def mask_values(c: Column) -> Column:
    """Paths, addresses, identifiers and hashes as placeholders."""
    for pattern, name in MASKS:
        c = F.regexp_replace(c, pattern, name)
    return c
