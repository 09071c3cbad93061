"""Nearest vectors of many queries against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa

from threatloom.operators import vectors as V


def similarity(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    norm = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return round(dot(a, b) / norm, 6) if norm else None


def test_top_k_per_query_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 7)
    rng = random.Random(3)
    same = [rng.randrange(-8, 8) / 4 for _ in range(4)]
    rows = [(i, f"l{i % 3}", [rng.randrange(-8, 8) / 4 for _ in range(4)] if i % 4 else list(same)) for i in range(120)]
    rows += [(200, "odd", None), (201, "odd", [0.0] * 4), (202, "odd", [1.0, None, 2.0, 0.5]), (203, "odd", [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    queries = [r for r in rows if r[0] % 10 == 0 or r[0] >= 201]
    asked = spark.createDataFrame([(i, q) for i, _, q in queries], "query_id long, q array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.label, r.similarity) for r in V.top_k_per_query(frame, asked, 5).collect()}
    want = {}
    for i, _, q in queries:
        scored = [(similarity(q, e), v, label) for v, label, e in rows if v != i and e is not None]
        scored.sort(key=lambda s: (math.inf if s[0] is None else -s[0], s[1]))
        want |= {(i, n + 1): (v, label, s) for n, (s, v, label) in enumerate(scored[:5])}
    assert got == want


def test_a_block_leaves_out_what_is_far():
    """A block hands on few pairs, of equal vectors too."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(50, 8)), 20, axis=0).tolist()
    vectors = pa.table({"vec_id": pa.array(range(1000), pa.int64()), "label": ["l"] * 1000, "embedding": pa.array(x, pa.list_(pa.float64()))})
    queries = pa.table({"query_id": pa.array(range(0, 1000, 50), pa.int64()), "q": pa.array(x[::50], pa.list_(pa.float64()))})
    assert V.nearest_of_block(5)(queries, vectors).num_rows <= 20 * 4 * 5
