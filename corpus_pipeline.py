"""The corpus pipeline: toxicity, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.

Defined cases of every stage: a null text is an empty one; rows with a null doc_id are documents like others; further columns
pass through unchanged (names that begin with two underscores are the stages' own); an empty table gives an empty one. Repeated rows and different texts under one
doc_id are told apart by doc_id and text: drop_copies keeps one row of each text, drop_near_copies decides by text.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import exact_dedup, minhash_dedup, packing, secret_scan, toxicity
from threatloom.llm.common import reliable, shared_folder, table, written
from threatloom.llm.minhash_dedup import BROADCAST_IDS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It is fitted on this stage's documents and the labels.

    Empty texts get the calibrated prior; without labels all documents stay; repeated rows share one fate.
    """
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, scorer)


#: Numbers of texts (partition and row) need less than this beyond the largest id, or below the smallest.
ROOM = 1 << 62


def repeated_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("doc_id")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text (A-Z lower-cased): of equal texts the row with the largest doc_id, of its repeated rows the least."""
    groups = exact_dedup.exact_groups(docs).where("kept").select("doc_id", F.col("group_size").alias("__rows"), F.col("text_sha256").alias("__text_digest"))
    keyed = docs.withColumn("__text_digest", exact_dedup.text_digest(F.col("text")))
    on = keyed["doc_id"].eqNullSafe(groups["doc_id"]) & (keyed["__text_digest"] == groups["__text_digest"])
    kept = keyed.join(groups.dropDuplicates(["doc_id", "__text_digest"]), on, "left_semi")
    if repeated_ids(docs).isEmpty():
        return kept.select(*docs.columns)
    # A column that has no order (a map, or what holds one) only breaks ties between rows that are equal otherwise.
    ordered = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString() and docs.schema[c].dataType.simpleString() != "variant"]
    return kept.groupBy("doc_id", "__text_digest").agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("__row")).select("__row.*")


def dropped(groups: DataFrame, name: str) -> DataFrame:
    """The ids that aren't kept. So few as BROADCAST_IDS are sent to where the texts lie, so that these aren't shuffled."""
    ids = reliable(groups.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Different texts under one doc_id are documents of their own: they are compared under ids that no other row has.
    """
    again = repeated_ids(docs.where("doc_id IS NOT NULL"))
    if not again.isEmpty():
        return drop_near_copies_by_text(docs, again)
    groups = minhash_dedup.near_groups(docs, words=5, percent=80)
    return docs.join(dropped(groups, "doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_near_copies_by_text(docs: DataFrame, again: DataFrame) -> DataFrame:
    keyed = docs.withColumn("__text_digest", exact_dedup.text_digest(F.col("text")))
    key = F.col("doc_id").cast("long")
    smallest, largest = docs.agg(F.min(key), F.max(key)).first()
    texts = keyed.join(again, "doc_id", "left_semi").select("doc_id", "__text_digest").distinct()
    number = F.monotonically_increasing_id()
    if largest < ROOM:
        fresh = F.lit(largest + 1) + number
    elif smallest > -ROOM:
        fresh = F.lit(smallest - 1) - number
    else:
        raise ValueError("the ids of documents reach both ends of 64 bits and leave no room for ids of texts")
    ids = reliable(texts.withColumn("__text_id", fresh))
    keyed = written(keyed.join(ids, ["doc_id", "__text_digest"], "left").withColumn("__text_id", F.coalesce("__text_id", F.col("doc_id").cast("long"))), "texts")
    groups = minhash_dedup.near_groups(keyed.select(F.col("__text_id").alias("doc_id"), "text"), words=5, percent=80)
    return keyed.join(dropped(groups, "__text_id"), "__text_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced by a mask; a null text stays null, n_chars follows the text."""
    masked = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens; an empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_windows),
]

#: The scoring, network and tokenizer stages can't be written in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
