"""What goes out: articles, annotations and bundles as files, read-only SQL, and a listing of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators.search import sql_verdict

LIST_TYPES = ("array",)


def flat(rows: DataFrame, separator: str = "; ") -> DataFrame:
    """Rows whose arrays of strings are joined, as CSV needs it."""
    return rows.select(*(F.array_join(c, separator).alias(c) if t.startswith(LIST_TYPES) else F.col(c) for c, t in rows.dtypes))


def recent(articles: DataFrame, *, as_of: str, days: int, source: str | None = None) -> DataFrame:
    """Articles of the last days before as_of, of one source or of all."""
    kept = articles.where(F.col("discovered_at") >= F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {int(days)} DAY"))
    return kept if source is None else kept.where(F.col("source") == source)


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV files with a header each, quotes doubled."""
    flat(rows).write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; nulls are left out."""
    rows.write.mode("errorifexists").json(path)


def training_rows(annotations: DataFrame, *, kind: str, usage: str) -> DataFrame:
    """Annotations of one kind and usage, for training only those not used before."""
    kept = annotations.where((F.col("annotation_type") == kind) & (F.col("usage") == usage))
    return kept.where(~F.coalesce(F.col("used"), F.lit(False))) if usage == "train" else kept


def canonical_json(*columns: str) -> Column:
    """Compact JSON with keys in order; null values are left out."""
    return F.to_json(F.struct(*sorted(columns)))


def bundle(rows: DataFrame, key: str, parts: dict[str, list[str]]) -> DataFrame:
    """For each row the SHA-256 of every part's canonical JSON, and that of the digests joined in the order of their names."""
    digests = rows.select(key, *(F.sha2(canonical_json(*columns).cast("binary"), 256).alias(f"{name}_sha256") for name, columns in sorted(parts.items())))
    names = [f"{name}_sha256" for name in sorted(parts)]
    return digests.withColumn("bundle_sha256", F.sha2(F.concat_ws("\n", *names).cast("binary"), 256))


def read_only(spark: SparkSession, sql: str, *, most: int = 200, cell: int = 300) -> DataFrame:
    """The rows of one SELECT as strings, limited in number and width; anything else raises ValueError."""
    verdict = spark.range(1).select(sql_verdict(F.lit(sql)).alias("v")).first().v
    if verdict != "ok" or ";" in sql:
        raise ValueError(f"not a read-only statement: {verdict}")
    found = spark.sql(sql)
    return found.limit(most).select(*(F.substring(F.col(f"`{c}`").cast("string"), 1, cell).alias(c) for c in found.columns))


def table_listing(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each column of the tables, with its place from 1."""
    rows = [(name, c, i) for name, df in tables.items() for i, c in enumerate(df.columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")
