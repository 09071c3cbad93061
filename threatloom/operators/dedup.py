"""Duplicate detection: content hashes, SimHash and first-of-key."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.text import content_hash, hamming

# Words that carry no weight in a SimHash.
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would "
    "could should may might can this that these those"
).split()
WORD = re.compile(r"\w+")


def content_duplicates(articles: DataFrame) -> DataFrame:
    """Hashes of contents that stand more than once, with how often and the first article."""
    hashed = articles.select("article_id", content_hash(F.col("content")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("first_id")).where("n > 1")


def dedup_stats(articles: DataFrame) -> DataFrame:
    counts = articles.select(content_hash(F.col("content")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_contents"), F.sum(F.col("n") - 1).alias("duplicates"), F.max("n").alias("largest_group")
    ).withColumn("duplicate_rate", F.round(F.col("duplicates") / F.col("total") * 100, 2))


def simhash(articles: DataFrame) -> DataFrame:
    """A signed 64-bit SimHash of title and content; 0 without tokens.

    Tokens are words of more than two characters that are no stop words. Each distinct token votes on every bit of the low half of
    its MD5 with its count. A hash depends on its row alone, so nothing is shuffled.
    """
    stop = frozenset(STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = Counter(w for w in WORD.findall(text.lower()) if len(w) > 2 and w not in stop)
                digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[8:] for w in words), dtype=np.uint8).reshape(-1, 8)
                votes = np.fromiter(words.values(), dtype=np.int64, count=len(words)) @ (np.unpackbits(digests, axis=1).astype(np.int64) * 2 - 1)
                out.append(int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["article_id", "simhash"])

    rows = articles.select(F.col("article_id").cast("long").alias("article_id"), F.concat_ws(" ", "title", "content").alias("text"))
    return rows.mapInArrow(run, "article_id long, simhash long")


def near_duplicates(hashes: DataFrame, *, distance: int = 3) -> DataFrame:
    """Links between articles in one bucket (the low four bits of their hashes) within the distance, with how many articles have each hash.

    Articles of equal hashes are linked at distance 0 with the first of them (id_a), each by one row, so a large group of copies
    is not multiplied; different hashes within the distance are linked by their first articles. Two articles are near copies
    if their first articles are the same or linked. The other 60 bits are cut into one band more than the distance; hashes that
    differ in so many bits at most agree in one of them, so pairs meet by bucket, band and value.
    """
    classes = hashes.groupBy("simhash").agg(F.count(F.lit(1)).alias("articles"), F.min("article_id").alias("first_id"))
    if not 0 <= distance < 60:
        raise ValueError("distance must be from 0 to 59")
    edges = [4 + 60 * i // (distance + 1) for i in range(distance + 2)]
    bands = [F.shiftrightunsigned("simhash", a).bitwiseAND(F.lit((1 << (z - a)) - 1)) for a, z in zip(edges[:-1], edges[1:], strict=True)]
    banded = classes.select(
        "*",
        F.col("simhash").bitwiseAND(F.lit(15)).alias("bucket"),
        F.posexplode(F.array(*bands)).alias("band", "part"),
    )
    x, y = banded.alias("x"), banded.alias("y")
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part"))
    close = (F.col("x.simhash") < F.col("y.simhash")) & (hamming(F.col("x.simhash"), F.col("y.simhash")) <= distance)
    pairs = x.join(y, on & close).select(
        F.col("x.first_id").alias("id_a"), F.col("y.first_id").alias("id_b"), F.col("x.articles").alias("n_a"), F.col("y.articles").alias("n_b"),
        hamming(F.col("x.simhash"), F.col("y.simhash")).alias("distance"),
    ).distinct()
    several = classes.where(F.col("articles") > 1)
    others = hashes.join(several, "simhash").where(~F.col("article_id").eqNullSafe(F.col("first_id")))
    return pairs.unionByName(
        others.select(F.col("first_id").alias("id_a"), F.col("article_id").alias("id_b"), F.col("articles").alias("n_a"), F.col("articles").alias("n_b"), F.lit(0).alias("distance"))
    )


def first_per_key(articles: DataFrame, *keys: str) -> DataFrame:
    """The first article of each key."""
    w = Window.partitionBy(*keys).orderBy("article_id")
    return articles.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def batch_dedup(articles: DataFrame, existing: DataFrame) -> DataFrame:
    """Each article with its fate: a known content, a content earlier in the batch, or new."""
    keyed = articles.withColumn("h", content_hash(F.col("content")))
    known = existing.select(content_hash(F.col("content")).alias("h")).distinct().withColumn("known", F.lit(True))
    first = keyed.groupBy("h").agg(F.min("article_id").alias("first_id"))
    joined = keyed.join(first, "h").join(known, "h", "left")
    reason = F.when(F.col("known"), "existing_content").when(F.col("article_id") != F.col("first_id"), "batch_content").otherwise("accepted")
    return joined.select("article_id", reason.alias("reason"))
