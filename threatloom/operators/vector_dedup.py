"""Classes of similar vectors over a whole table: signed random projections find candidates, exact cosines confirm them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.operators.components import components
from threatloom.session import map_rows

#: Recall that the bands are chosen for at the threshold itself, members of a bucket that are aimed at, and members of a block.
RECALL, BUCKET, BLOCK = 0.995, 256, 1000


def banding(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a band, growing with the table so that buckets don't, and bands: vectors at the threshold share one with RECALL."""
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    bits = max(8, math.ceil(math.log2(max(1, n) / BUCKET)))
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits))) if agree < 1 else 1


def unit(column: pa.ListArray) -> np.ndarray:
    width = len(column[0])
    x = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(vectors: DataFrame, bits: int, bands: int, seed: int = 0) -> DataFrame:
    """band, key and vec_id: of each vector the signs of its projections, a number for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(1))
            if x.shape[1] not in planes:
                planes[x.shape[1]] = np.random.default_rng(seed).normal(size=(x.shape[1], bits * bands))
            signs = (x @ planes[x.shape[1]] > 0).reshape(len(x), bands, bits)
            keys = signs @ (1 << np.arange(bits, dtype=np.int64))
            cols = [np.tile(np.arange(bands, dtype=np.int32), len(x)), keys.ravel(), np.repeat(batch.column(0).to_numpy(), bands)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["band", "key", "vec_id"])

    return map_rows(vectors, run, "band int, key long, vec_id long")


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links between numbers only those that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def links(vectors: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between distinct vectors (vec_id, embedding) of one width whose cosine is threshold or more, enough of them to join each class.

    A bucket is cut into blocks, and every pair of its blocks is a group of its own. A group gives a forest of its links, so no
    group makes more rows than it has members.
    """
    bits, bands = banding(vectors.count(), threshold)
    placed = keyed(vectors, bits, bands)
    sizes = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = placed.join(sizes, ["band", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "key", "vec_id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = pairs.join(vectors, "vec_id")

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        ids, own, x = part["vec_id"].to_numpy(), part["own"].to_numpy(), unit(part["embedding"].combine_chunks())
        i, j = key[2].as_py(), key[3].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = x[left] @ x[right].T >= threshold - 1e-12
        if i == j:
            near = np.triu(near, 1)
        p, q = np.nonzero(near)
        found = forest(ids[left[p]], ids[right[q]])
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return full.groupBy("band", "key", "i", "j").applyInArrow(lambda key, part: compare(key, part), "a long, b long").distinct()


def vector_classes(vectors: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """vec_id, class_id (the smallest id of its class) and members, of every vector that isn't null, empty, zero or odd in a component.

    Equal vectors form a class before any search. Vectors are one class if a chain of cosines of threshold or more leads from one to the other.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~odd & F.exists("embedding", lambda v: v != 0))
    first = rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"))
    widths = [r[0] for r in first.select(F.size("embedding")).distinct().limit(100).collect()]
    joined = rows.join(first, "embedding").select("vec_id", "rep")
    reps = first.select(F.col("rep").alias("vec_id"), "embedding")
    found = None
    for width in widths:  # vectors of different width are never alike
        part = links(reps.where(F.size("embedding") == width), threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return joined.select("vec_id", F.col("rep").alias("class_id"), F.lit(0).cast("long").alias("members")).where("false")
    classes = components(found)
    full = joined.join(classes, F.col("rep") == F.col("node"), "left").select("vec_id", F.coalesce("component", "rep").alias("class_id"))
    sizes = full.groupBy("class_id").agg(F.count(F.lit(1)).alias("members"))
    return full.join(sizes, "class_id").select("vec_id", "class_id", "members")
