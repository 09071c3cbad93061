"""Vector search over array columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.text import cosine

#: Vectors and queries that meet in one block.
BLOCK_VECTORS, BLOCK_QUERIES = 20_000, 500
#: Products of matrices differ from exact cosines by much less than this, and rounding to six places by half a millionth.
MARGIN = 1e-5


def as_column(query: list[float] | Column) -> Column:
    return query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))


def top_k(vectors: DataFrame, query: list[float] | Column, k: int, *, threshold: float | None = None, prefilter: bool = False) -> DataFrame:
    """The k nearest by cosine to a vector, or to a column that holds it. The threshold comes after the limit unless prefilter is set."""
    q = as_column(query)
    scored = vectors.where(F.col("embedding").isNotNull()).withColumn("similarity", F.round(cosine(F.col("embedding"), q), 6))
    keep = F.lit(True) if threshold is None else F.col("similarity") >= threshold
    if prefilter:
        scored = scored.where(keep)
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(k).where(keep)


def rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The length of each vector, -1 if it holds a null, and the entries of all in a row."""
    lists = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).copy()
    entries = pc.list_flatten(lists)
    sizes[pc.list_parent_indices(lists).filter(pc.is_null(entries)).to_numpy(zero_copy_only=False)] = -1
    return sizes, lists


def matrix(lists: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return pc.list_flatten(lists.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)


def first_of_each(keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest ids of each key."""
    order = np.lexsort([ids, *keys.T])
    new = np.append(True, (keys[order][1:] != keys[order][:-1]).any(1))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def nearest_of_block(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of queries and one of vectors, all pairs that may be among a query's k nearest: a product of matrices leaves out those that can't be.

    Cosines that aren't defined come last and those that aren't numbers first, the smallest ids of both; of equal vectors the smallest ids stay too.
    """

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q_sizes, q_lists = rows_of(queries["q"])
        v_sizes, v_lists = rows_of(vectors["embedding"])
        q_ids, v_ids = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy()
        by_id = np.argsort(v_ids, kind="stable")
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for width in np.unique(q_sizes).tolist():
            mine, fit = np.flatnonzero(q_sizes == width), np.flatnonzero((v_sizes == width) & (width > 0))
            v = matrix(v_lists, fit, max(width, 0)) if len(fit) else np.zeros((0, 1))
            v_norm = np.sqrt((v * v).sum(1))
            for at in range(0, len(mine), 64):
                some = mine[at : at + 64]
                q = matrix(q_lists, some, width) if len(fit) else np.zeros((len(some), 1))
                with np.errstate(all="ignore"):
                    norm = np.sqrt((q * q).sum(1))[:, None] * v_norm
                    cosines = np.full((len(some), len(v_ids)), -np.inf)  # not defined
                    cosines[:, fit] = np.where(norm == 0, -np.inf, np.nan_to_num(q @ v.T / norm, nan=np.inf, posinf=np.inf, neginf=np.inf))
                for row, i in enumerate(some.tolist()):
                    s = cosines[row]
                    other = v_ids != q_ids[i]
                    number = np.isfinite(s) & other
                    least = np.partition(s[number], -k)[-k] - MARGIN if number.sum() > k else -np.inf
                    near = np.flatnonzero(number & (s >= least))
                    if len(near) > 4 * k:  # equal vectors have equal cosines
                        x = matrix(v_lists, near, width)
                        products = np.stack([np.cumsum(x * q[row], axis=1)[:, -1], np.cumsum(x * x, axis=1)[:, -1]], axis=1)
                        near = near[first_of_each(products, v_ids[near], k)]
                    odd = [by_id[((s == what) & other)[by_id]][:k] for what in (np.inf, -np.inf)]
                    kept = np.concatenate([near, odd[0], odd[1] if number.sum() + len(odd[0]) < k else odd[1][:0]])
                    left.append(np.full(len(kept), i))
                    right.append(kept)
        a, b = queries.take(pa.array(np.concatenate(left))), vectors.take(pa.array(np.concatenate(right)))
        return pa.table({"query_id": a["query_id"], "q": a["q"], "vec_id": b["vec_id"], "label": b["label"], "embedding": b["embedding"]})

    return run


def top_k_per_query(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query row (query_id, q). Blocks of vectors and of queries, sized from their counts, meet pair by pair; exact cosines rank what each pair of blocks leaves."""
    vectors = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "label", "embedding")
    queries = queries.where("query_id IS NOT NULL").select("query_id", "q")
    n_v, n_q = max(1, -(-vectors.count() // BLOCK_VECTORS)), max(1, -(-queries.count() // BLOCK_QUERIES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", deal("query_id", n_q)).withColumn("vb", every(n_v))
    right = vectors.withColumn("vb", deal("vec_id", n_v)).withColumn("qb", every(n_q))
    kinds = {f.name: f.dataType for f in (*queries.schema, *vectors.schema)}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("query_id", "q", "vec_id", "label", "embedding")])
    met = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(nearest_of_block(k), schema)
    scored = met.select("query_id", "vec_id", "label", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_per_label(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_centroids(vectors: DataFrame) -> DataFrame:
    """The mean of each component by label."""
    parts = vectors.select("label", F.posexplode("embedding").alias("dim", "x"))
    return parts.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def section_similarity(title: str, description: str, tags: str, signature: str):
    """The weighted sum of four section similarities (fixed weights)."""
    return 0.042 * F.col(title) + 0.042 * F.col(description) + 0.042 * F.col(tags) + 0.874 * F.col(signature)


def best_per_label(vectors: DataFrame, query: list[float] | Column, *, threshold: float) -> DataFrame:
    """The nearest vector of each label, by pre-aggregation, and whether it meets the threshold."""
    q = as_column(query)
    scored = vectors.where(F.col("embedding").isNotNull()).select("label", "vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("similarity"))
    best = scored.groupBy("label").agg(F.max(F.struct("similarity", (-F.col("vec_id")).alias("back"))).alias("m"))
    return best.select("label", (-F.col("m.back")).alias("vec_id"), F.col("m.similarity").alias("similarity"), (F.col("m.similarity") >= threshold).alias("meets_threshold"))
