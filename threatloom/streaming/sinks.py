"""Keyed tables that batches are written into: inserts with conflicts, and matches that are updated in place.

A table is a folder with a folder for each batch and output, batch=N; a batch counts once its mark stands in commits, which is
written last. A batch sees the committed rows of earlier batches only and overwrites what an earlier try of its own left, so one that is
replayed, whether its writer failed or its checkpoint was lost, gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatloom.functions.text import content_hash, hamming, hunt_score
from threatloom.operators.dedup import simhash

# Bits in which near copies differ at most, the low bits that make a bucket, and the score from which an article's chunks are analysed.
DISTANCE, BUCKET_BITS, CHUNK_SCORE = 3, 4, 50
KEY = ["article_id", "rule_id", "match_level", "chunk_id"]


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def commits(spark: SparkSession, folder: str) -> list[int]:
    """The batches that count."""
    return sorted(r[0] for r in spark.read.parquet(f"{folder}/commits").select("batch").distinct().collect()) if exists(spark, f"{folder}/commits") else []


def stored(spark: SparkSession, folder: str, output: str, *, before: int | None = None) -> DataFrame | None:
    """The rows of an output with their batch; None if no batch counts yet."""
    numbers = [n for n in commits(spark, folder) if before is None or n < before]
    if not numbers:
        return None
    return spark.read.option("basePath", f"{folder}/{output}").parquet(*(f"{folder}/{output}/batch={n}" for n in numbers))


def put(rows: DataFrame, folder: str, output: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/{output}/batch={batch}")


def commit(spark: SparkSession, folder: str, batch: int) -> None:
    spark.createDataFrame([(batch,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")


def near_links(hashes: DataFrame, known: DataFrame | None, *, distance: int = DISTANCE) -> DataFrame:
    """article_id, similar_id and distance: for each of hashes (article_id, simhash) the hashes of its bucket that differ in so many bits at most.

    A hash is represented by its first known article, else by the first of hashes, so a large group of one hash isn't multiplied; an article
    only meets representatives that are known or come before it. The bits above the bucket are cut into one band more than the
    distance, so similar hashes agree in one; a pair counts in the first they share.
    """
    tagged = hashes.select("simhash", F.lit(1).alias("tag"), "article_id")
    if known is not None:
        tagged = tagged.unionByName(known.select("simhash", F.lit(0).alias("tag"), "article_id"))
    classes = tagged.groupBy("simhash").agg(F.min(F.struct("tag", "article_id")).alias("m")).select("simhash", "m.tag", F.col("m.article_id").alias("similar_id"))
    edges = [BUCKET_BITS + (64 - BUCKET_BITS) * i // (distance + 1) for i in range(distance + 2)]
    parts = F.array(*(F.shiftrightunsigned("simhash", a).bitwiseAND(F.lit((1 << (z - a)) - 1)) for a, z in zip(edges[:-1], edges[1:], strict=True)))
    bucket = F.col("simhash").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("bucket")
    mine = hashes.select("simhash").distinct().select(F.col("simhash").alias("a"), bucket, parts.alias("pa"), F.posexplode(parts).alias("band", "part"))
    theirs = classes.select(F.col("simhash").alias("b"), "tag", "similar_id", bucket, parts.alias("pb"), F.posexplode(parts).alias("band", "part"))
    bits, first = hamming(F.col("a"), F.col("b")), F.array_position(F.zip_with("pa", "pb", lambda x, y: x == y), True) - 1
    met = mine.join(theirs, ["bucket", "band", "part"]).where((bits <= distance) & (first == F.col("band"))).select(F.col("a").alias("simhash"), "tag", "similar_id", bits.alias("distance"))
    return hashes.join(met, "simhash").where("tag = 0 OR article_id > similar_id").select("article_id", "similar_id", "distance")


def insert(spark: SparkSession, folder: str, rows: DataFrame, batch: int) -> None:
    """Adds articles (article_id, title, content and more) whose content is new to the table; of equal ones in the batch the first by id.

    articles holds what was added, with content_hash, simhash, bucket and whether its chunks are to be analysed; conflicts the rest, with
    the article that is in the way; similar the near copies of what was added among articles of earlier batches and of its own.
    """
    keyed = rows.withColumn("content_hash", content_hash(F.col("content")))
    known = stored(spark, folder, "articles", before=batch)
    order = Window.partitionBy("content_hash").orderBy("article_id")
    ranked = keyed.withColumns({"__first": F.first("article_id").over(order), "__rank": F.row_number().over(order)})
    if known is None:
        ranked = ranked.withColumn("__known", F.lit(None).cast("long"))
    else:
        ranked = ranked.join(known.select("content_hash", F.col("article_id").cast("long").alias("__known")), "content_hash", "left")
    new = F.col("__known").isNull() & (F.col("__rank") == 1)
    added = ranked.where(new).select(*keyed.columns)
    hashes = simhash(added)
    full = added.join(hashes, "article_id").withColumns(
        {"bucket": F.col("simhash").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int"), "analyse_chunks": hunt_score(F.concat_ws(" ", "title", "content")) > CHUNK_SCORE}
    )
    put(full, folder, "articles", batch)
    refused = ranked.where(~new).select("article_id", F.coalesce("__known", "__first").alias("existing_id"), "content_hash", F.concat(F.lit("Duplicate content hash: "), F.substring(F.coalesce("title", F.lit("")), 1, 50), F.lit("...")).alias("message"))
    put(refused, folder, "conflicts", batch)
    mine = spark.read.parquet(f"{folder}/articles/batch={batch}").select("article_id", "simhash")
    put(near_links(mine, None if known is None else known.select("article_id", "simhash")), folder, "similar", batch)
    commit(spark, folder, batch)


def upsert_matches(spark: SparkSession, folder: str, rows: DataFrame, batch: int, at: Column) -> None:
    """Stores matches: one row for each article, rule, level and chunk (null: none), the last of the batch by similarity if it has several.

    A match that is there keeps its creation time and takes everything else from the batch.
    """
    values = [c for c in rows.columns if c not in KEY]
    last = rows.groupBy(*KEY).agg(F.max(F.struct("similarity", *(c for c in values if c != "similarity"))).alias("r"))
    fresh = last.select(*KEY, *(F.col(f"r.{c}").alias(c) for c in values), at.alias("updated_at"))
    known = matches(spark, folder, before=batch)
    if known is None:
        full = fresh.withColumn("created_at", F.col("updated_at"))
    else:
        old = known.select(*(F.col(k).alias(f"__{k}") for k in KEY), F.col("created_at").alias("__created"))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY]
        full = fresh.join(old, same, "left").withColumn("created_at", F.coalesce("__created", "updated_at")).select(*fresh.columns, "created_at")
    put(full, folder, "matches", batch)
    commit(spark, folder, batch)


def matches(spark: SparkSession, folder: str, *, before: int | None = None) -> DataFrame | None:
    """The current row of each match: that of its last batch."""
    rows = stored(spark, folder, "matches", before=before)
    if rows is None:
        return None
    values = [c for c in rows.columns if c not in (*KEY, "batch")]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*KEY, *(F.col(f"r.{c}").alias(c) for c in values))


def inserter(folder: str, read: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """insert() for a stream's foreachBatch."""
    return lambda rows, batch: insert(rows.sparkSession, folder, read(rows), batch)
