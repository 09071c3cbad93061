"""Exact duplicates by a 128-bit content hash, with a byte comparison inside hash groups.

Main path, DataFrame functions only:
1. every row becomes (doc_id, 128-bit hash, text digest); rows are grouped by hash with map-side
   partial aggregation, so a group that holds a third of all rows sends one row for each task;
2. texts are grouped by (hash, text), again pre-aggregated: a hash that has more than one text is a
   collision. This compares bytes, and its only large shuffle carries each distinct text of a task once;
3. each row joins its group by hash (adaptive skew joins split a hot hash), or, for a collided hash,
   by hash and text.

Equal means identical after lower-casing A-Z; null counts as empty. The largest (or smallest)
doc_id of a group stays; a null doc_id stays only where the group has no other. Repeated rows with one
doc_id are members of one group and are returned as often as they come; all copies of the row
that stays are marked kept. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import lower_ascii, reliable


def text_digest(text: Column) -> Column:
    return F.sha2(lower_ascii(text).cast("binary"), 256)


def hashed(docs: DataFrame) -> DataFrame:
    text = lower_ascii(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text")).select(
        "doc_id", "_text", F.md5(F.col("_text").cast("binary")).alias("_hash"), F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
    )


def exact_groups(docs: DataFrame, *, keep: str = "max") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = hashed(docs)
    chosen = (F.max if keep == "max" else F.min)("_keep").alias("_keep")
    pick = (F.max if keep == "max" else F.min)("doc_id").alias("_keep")
    texts = rows.groupBy("_hash", "_text").agg(pick, F.count(F.lit(1)).alias("_n"))
    # Small rows; written once, so that texts are shuffled once.
    by_hash = reliable(texts.groupBy("_hash").agg(chosen, F.sum("_n").alias("_n"), (F.count(F.lit(1)) > 1).alias("_collided")))
    slim = rows.select("doc_id", "_hash", "text_sha256")
    out = slim.join(by_hash.where(~F.col("_collided")).select("_hash", "_keep", "_n"), "_hash").select("doc_id", "_keep", "_n", "text_sha256")
    clash = by_hash.where("_collided").select("_hash")
    if not clash.isEmpty():
        apart = rows.join(clash, "_hash", "left_semi").join(texts.join(clash, "_hash", "left_semi"), ["_hash", "_text"])
        out = out.unionByName(apart.select("doc_id", "_keep", "_n", "text_sha256"))
    return out.select(
        "doc_id",
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"),
        "text_sha256",
    )
