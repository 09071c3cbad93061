"""Chunking, chunk features and filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.text import KEYWORDS, hits
from threatloom.operators.labels import keyword_verdict
from threatloom.session import map_rows


CHUNK = "article_id long, chunk int, start int, end int, chunk_text string"


def cut(articles: DataFrame, ends: Callable[[str], Iterator[tuple[int, int]]]) -> DataFrame:
    """A row for each piece that ends(text) gives, cut inside Arrow batches: one pass over a text, however many pieces it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for article_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows := [(article_id, i, a, z, text[a:z]) for i, (a, z) in enumerate(ends(text or ""))]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["article_id", "chunk", "start", "end", "chunk_text"])

    return map_rows(articles.select(F.col("article_id").cast("long").alias("article_id"), "content"), run, CHUNK)


def fixed_chunks(articles: DataFrame, *, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of size characters, each overlapping the one before; nothing of an empty content."""
    return cut(articles, lambda text: ((a, min(a + size, len(text))) for a in range(0, max(len(text) - overlap, 1) if text else 0, size - overlap)))


def sentence_chunks(articles: DataFrame, *, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks whose end moves back to the last full stop of the final 100 characters, if there is one; always moves forward."""

    def ends(text: str) -> Iterator[tuple[int, int]]:
        start = 0
        while start < len(text):
            end = min(start + size, len(text))
            if end < len(text) and (stop := text.rfind(".", max(0, end - 100), end)) >= 0:
                end = stop + 1
            yield start, end
            start = len(text) if end >= len(text) else max(end - overlap, start + 1)

    return cut(articles, ends)


def features(text: Column, registry: dict[str, list[str]] = KEYWORDS) -> list[Column]:
    """Counts and ratios of a chunk, native throughout."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    words, chars = F.greatest(count(r"[A-Za-z0-9]+"), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    return [
        F.length(text).alias("chars"),
        count(r"[A-Za-z0-9]+").alias("words"),
        count(r"[.!?]+").alias("sentence_marks"),
        F.round(count(r"[A-Z]") / chars, 4).alias("upper_ratio"),
        F.round(count(r"[0-9]") / chars, 4).alias("digit_ratio"),
        F.round(F.length(F.regexp_replace(text, r"[^A-Za-z0-9]", "")) / words, 4).alias("chars_per_word"),
        count(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b").alias("addresses"),
        count(r"\b[0-9a-f]{32,64}\b").alias("hashes"),
        count(r"https?://").alias("links"),
        *(reduce(lambda a, b: a + b, (h.cast("int") for h in hits(text, ws)), F.lit(0)).alias(f"{tier}_matches") for tier, ws in registry.items()),
    ]


def chunk_features(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", *features(F.coalesce(F.col("content"), F.lit(""))))


def technique_ids(articles: DataFrame) -> DataFrame:
    """Distinct technique identifiers (T and four digits, with a sub-number or not) cited by each article."""
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col("content"), F.lit(r"\bT[0-9]{4}(?:\.[0-9]{3})?\b"), F.lit(0))))
    return articles.select("article_id", ids.alias("techniques"))


# Phrases of pages that block a reader, in texts of under 2000 characters.
BLOCK_PAGES = (
    "access denied", "bot detected", "captcha", "please enable javascript", "javascript is required", "cloudflare", "temporarily unavailable",
    "403 forbidden", "404 not found",
)


def quality_gate(articles: DataFrame, *, min_chars: int = 100, min_words: int = 50) -> DataFrame:
    """The first reason that an article is turned away for, or 'ok'."""
    c = F.coalesce(F.col("content"), F.lit(""))
    reason = (
        F.when(F.length(c) < min_chars, "too_short")
        .when((F.length(c) < 2000) & reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(p)) for p in BLOCK_PAGES)), "block_page")
        .when(F.regexp_count(c, F.lit(r"[^ \t\r\n\f\x0B]+")) < min_words, "too_few_words")
        .when(F.length(F.regexp_replace(c, r"[^.!?]", "")) < 2, "no_sentences")
        .otherwise("ok")
    )
    return articles.select("article_id", reason.alias("reason"))


def filtered_chunks(cut: DataFrame, *, threshold: float, registry: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Of each article, the chunks with a keyword of the perfect tier or a positive verdict of at least threshold, joined in their order.

    An article without such a chunk stays, with an empty text. The texts of an article meet in one row, as they did before the cut.
    """
    positive, sure = keyword_verdict(F.col("chunk_text"), registry)
    perfect = reduce(lambda a, b: a | b, hits(F.col("chunk_text"), registry["perfect"]), F.lit(False))
    judged = cut.select("article_id", "chunk", F.when(perfect | (positive & (sure >= threshold)), F.col("chunk_text")).alias("text"))
    grouped = judged.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count("text").alias("kept"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("kept_chars"),
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("chunk", "text")))).alias("parts"),
    )
    return grouped.withColumn("kept_text", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")).drop("parts")
