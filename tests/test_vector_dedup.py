"""Classes of similar vectors against all pairs, and components against plain Python."""

import random

import numpy as np
import pytest

from threatloom.operators import vector_dedup as V
from threatloom.operators.components import components


def classes(pairs, nodes):
    head = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            head[a] = head[b] = min(head[a], head[b])
    return head


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = [p for p in pairs if p[0] != p[1]]
    assert got == classes(linked, {x for p in linked for x in p})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1000, 5])
def test_vector_classes_find_what_all_pairs_find(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + rng.normal(size=24) * rng.uniform(0, 0.6)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, [0.0] * 24), (2001, None), (2002, [float("nan")] * 24), (2003, []), (2004, [2.0 * x for x in rows[3][1]]), (2005, [1.0, 2.0]), (2006, [1.0, 2.1])]
    got = {r.vec_id: (r.class_id, r.members) for r in V.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.9).collect()}
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and np.isfinite(v).all() and any(v)}
    ids = [i for i in usable if len(usable[i]) == 24]
    x = np.array([usable[i] for i in ids])
    near = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True)] + [(2005, 2006)]
    want = classes(near, usable)
    assert set(got) == set(usable) and sum(got[a][0] == got[b][0] for a, b in near) >= 0.9 * len(near)
    assert all(want[i] <= c for i, (c, _) in got.items()) and sum(c == want[i] for i, (c, _) in got.items()) >= 0.9 * len(got)
    assert all(n == sum(d == c for d, _ in got.values()) for c, n in got.values())


def test_recall_on_a_driver_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if r.embedding]
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.triu(x @ x.T, 1)
    threshold = float(np.sort(sims[sims > 0])[-300])  # some hundred links
    near = [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(sims >= threshold), strict=True)]
    got = {r.vec_id: r.class_id for r in V.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), threshold=threshold).collect()}
    recall = sum(got[a] == got[b] for a, b in near) / len(near)
    print("threshold", threshold, "links", len(near), "recall", recall)
    assert recall >= 0.9
