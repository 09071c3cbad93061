"""Exact top-k by integer inner product, by exhaustive term-at-a-time accumulation.

A vector is a sparse row over its dimensions. Candidates and queries are dealt to blocks by id; each
pair of a query block and a candidate block is one group of a cogroup. In a group, dimension after
dimension scatters its postings (the candidates' values), weighted by the queries that have the
dimension, into dense score arrays; partition selection takes each query's k best of the block.
A window over the k rows of each block merges them. A block holds about QUERY_CELLS or CANDIDATE_CELLS components,
whatever the size of the tables and the width of the vectors, and hashing spreads equal vectors.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor
do rows with a null id; of rows with one vec_id all count as candidates for other ids, none for its own, and
a query is answered once for each distinct (id, vector); vectors of different lengths are compared over their
common dimensions; ties go to the smaller vec_id.
Components saturate at the ends of a 64-bit integer, and scores are sums modulo 2^64, which no components below 2^27 in
up to 1024 dimensions reach.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components of a block on either side, and scores that are held at once.
QUERY_CELLS, CANDIDATE_CELLS, SCORES = 1 << 17, 1 << 20, 1 << 22
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(256 * x) of each component, of rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~odd)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * 256).cast("long")).alias("q"))


def dense(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best_of_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """Term-at-a-time scores of a slice of queries against all candidates of the block, and their k best."""
    candidates = candidates.sort_values("vec_id", kind="stable")
    ids = candidates["vec_id"].to_numpy()
    width = max(max(map(len, queries["q"])), max(map(len, candidates["q"])))
    postings, weights = np.ascontiguousarray(dense(candidates["q"], width).T), dense(queries["q"], width)
    query_ids, out = queries["query_id"].to_numpy(), []
    size = max(1, SCORES // len(ids))
    for at in range(0, len(weights), size):
        part, own = weights[at : at + size], query_ids[at : at + size]
        scores = np.zeros((len(part), len(ids)), dtype=np.int64)
        for term in range(width):
            has = np.flatnonzero(part[:, term])  # the sparse query rows that have the term
            where = np.flatnonzero(postings[term])
            if len(has) and len(where) == len(ids):
                scores[has] += part[has, term, None] * postings[term]
            elif len(has) and len(where):
                scores[np.ix_(has, where)] += part[has, term, None] * postings[term, where]
        allowed = own[:, None] != ids
        for q, row, ok in zip(own, scores, allowed, strict=True):
            keep = np.flatnonzero(ok)
            if len(keep) > k:
                edge = np.partition(row[keep], len(keep) - k)[len(keep) - k]
                above = keep[row[keep] > edge]
                keep = np.concatenate([above, keep[row[keep] == edge][: k - len(above)]])  # ids ascend, so ties are settled
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[keep], "score": row[keep]}))
    return pd.concat(out, ignore_index=True)


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by every."""
    rows = quantised(vectors)
    cells, asked_cells = rows.agg(F.sum(F.size("q")), F.sum(F.when(F.col("vec_id") % every == 0, F.size("q")))).first()
    n_cand, n_query = max(1, math.ceil((cells or 0) / CANDIDATE_CELLS)), max(1, math.ceil((asked_cells or 0) / QUERY_CELLS))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "q"), F.lit(n)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "q").distinct()
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id", "q"), F.lit(n_query)).cast("int")).withColumn("cb", all_blocks(n_cand))
    stored = rows.withColumn("cb", block(n_cand)).withColumn("qb", all_blocks(n_query))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return best_of_block(left, right, k)

    found = asked.groupBy("qb", "cb").cogroup(stored.groupBy("qb", "cb")).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
