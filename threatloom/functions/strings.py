"""Further text expressions: summaries, normal forms, spans and labels."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.functions.text import collapse_whitespace


def summary(text: Column, *, most: int = 500) -> Column:
    """As many first sentences as fit; if none does, as many words as fit before dots."""
    flat = collapse_whitespace(F.coalesce(text, F.lit("")))
    fitting = lambda parts, limit: F.aggregate(
        parts,
        F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda acc, p: F.struct(
            F.when(acc["full"] | (F.length(F.trim(F.concat(acc["s"], F.lit(" "), p))) > limit), acc["s"]).otherwise(F.trim(F.concat(acc["s"], F.lit(" "), p))).alias("s"),
            (acc["full"] | (F.length(F.trim(F.concat(acc["s"], F.lit(" "), p))) > limit)).alias("full"),
        ),
    )["s"]
    whole = fitting(sentences(F.substring(flat, 1, most + 1_000)), most)
    words = fitting(F.split(F.substring(flat, 1, most), " "), most - 3)
    return F.when(whole != "", whole).otherwise(F.concat(words, F.lit("...")))


def sentences(text: Column) -> Column:
    """Parts between runs of . ! and ?, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


# Characters and what stands for them in a normal form; the fifth is replaced as it stands.
PLAIN_CHARACTERS = {"“": '"', ": \"'\", ": "'", "–": "-", "—": "-", "…": "...", "©": "(c)", "®": "(r)", "™": "(tm)"}


def accents() -> tuple[str, str]:
    """Characters of the basic plane that are one other without their marks, with that; then marks alone, which go. Hangul, which takes apart into letters, stays."""
    bare = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    changed = [(c, bare(c)) for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and bare(c) != c and len(bare(c)) <= 1]
    changed.sort(key=lambda x: not x[1])
    return "".join(c for c, _ in changed), "".join(b for _, b in changed)


def normal_form(text: Column) -> Column:
    """Lower case without accents, typographic characters as plain ones; everything but letters, digits, white space and . , ; : ? as blanks, and those single."""
    c = F.coalesce(text, F.lit(""))
    for found, plain in PLAIN_CHARACTERS.items():
        c = F.replace(c, F.lit(found), F.lit(plain))
    c = F.translate(c, *accents())
    return F.lower(collapse_whitespace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s.,;:?]", " ")))


def content_hash_normalised(title: Column, content: Column) -> Column:
    """SHA-256 of title and content in lower case with single blanks."""
    flat = lambda c: F.lower(collapse_whitespace(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat(flat(title), F.lit("\n"), flat(content)).cast("binary"), 256)


def fingerprint(title: Column, content: Column) -> Column:
    """MD5 of the first twenty, in order, of the distinct words of more than three characters in title and first line."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", title, F.substring_index(content, "\n", 1))), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    chosen = F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))), 1, 20)
    return F.md5(F.array_join(chosen, " ").cast("binary"))


def span_form(text: Column, *, strict: bool = False) -> Column:
    """Quotes unified, ends trimmed; unless strict, runs of white space as one blank."""
    c = F.translate(F.coalesce(text, F.lit("")), "‘’“”", "''\"\"")
    return F.regexp_replace(c, r"^\s+|\s+$", "") if strict else collapse_whitespace(c)


def without_carets(text: Column) -> Column:
    return F.replace(text, F.lit("^"), F.lit(""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words of two texts over all their words: 1 if both have none, 0 if one has none."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))
    either = F.size(F.array_union(words(a), words(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / either)


def embedding_text(title: Column, source: Column, content: Column, score: Column) -> Column:
    """The text that a vector is made of: title, source, score and the beginning of the content, a line each."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Title: "), F.substring(title, 1, 200)), F.concat(F.lit("Source: "), F.substring(source, 1, 100)),
        F.concat(F.lit("Score: "), score.cast("string")), F.concat(F.lit("Content: "), F.substring(content, 1, 3000)),
    )


def least_length(host: Column, by_domain: dict[str, int], default: int = 200) -> Column:
    """The least length of a text by its domain: the domain itself, else one that it ends in, else the default."""
    exact = reduce(lambda a, kv: F.when(host == kv[0], kv[1]).otherwise(a), by_domain.items(), F.lit(None).cast("int"))
    ending = reduce(lambda a, kv: F.when(F.endswith(host, F.lit("." + kv[0])), kv[1]).otherwise(a), by_domain.items(), F.lit(None).cast("int"))
    return F.coalesce(exact, ending, F.lit(default))


def platform_labels(text: Column, weights: dict[str, dict[str, int]], *, floor: int = 3) -> Column:
    """Platforms whose tokens in the text weigh at least floor and half of the heaviest, in order of weight, then name."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    scored = F.array(*(
        F.struct((-reduce(lambda a, kv: a + F.when(F.contains(lowered, F.lit(kv[0])), kv[1]).otherwise(0), tokens.items(), F.lit(0))).alias("w"), F.lit(name).alias("name"))
        for name, tokens in weights.items()
    ))
    best = F.array_min(F.transform(scored, lambda x: x["w"]))
    return F.transform(F.array_sort(F.filter(scored, lambda x: (x["w"] <= -floor) & (x["w"] * 2 <= best))), lambda x: x["name"])
