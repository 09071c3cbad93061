"""What several corpus operators share: table access, Arrow mapping, checkpoints and text normalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so a batch holds few of them.
BATCH_ROWS = 200
#: Bytes in one Arrow batch, where this Spark version heeds it.
BATCH_BYTES = 16 << 20

#: Bytes that a task holds before it writes a row group; rows of ids and texts are large.
ROW_GROUP_BYTES = 16 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def lower_ascii_py(text: str | None) -> str:
    """The same in Python: bytes.lower() touches A-Z only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow in batches small enough for long texts; rows stay in their partition."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset, as in tests, one under the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same as a Parquet table in the shared folder: like a checkpoint, but compressed by column, for large tables.

    Column chunks are read in turn: vectored reads keep a native buffer of a chunk's size for each of their threads.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).option("parquet.hadoop.vectored.io.enabled", "false").parquet(path)


#: A key that holds more than one in so many rows is heavy; there are fewer such keys than this.
HEAVY_SHARE = 1_000


def heavy_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int, count: str = "n") -> DataFrame:
    """rows joined to keys (one row for each key, with the count of its rows of total), whatever a single key holds.

    The heavy keys, fewer than HEAVY_SHARE, are broadcast and their rows stay where they are; all others are shuffled.
    """
    is_heavy = F.col(count) * HEAVY_SHARE > total
    heavy = keys.where(is_heavy).drop(count)
    if heavy.isEmpty():
        return rows.join(keys.drop(count), on)
    light = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(keys.where(~is_heavy).drop(count), on)
    return rows.join(F.broadcast(heavy), on).unionByName(light)
