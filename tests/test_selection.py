"""Exact medians whatever the size of a group."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from threatloom.operators import selection


@pytest.mark.parametrize(("small", "buckets"), [(100_000, 4096), (50, 4096), (0, 3), (7, 16)])
def test_medians_equal_plain_python(spark, monkeypatch, small, buckets):
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    rng = random.Random(small)
    groups = {
        "skew": [rng.lognormvariate(0, 4) for _ in range(3001)], "ties": [rng.choice([1.5, 2.5, 2.5, 9.0]) for _ in range(400)], "one": [7.25], "two": [1.0, 2.0], "same": [3.0] * 99,
        "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0], "sign": [rng.uniform(-1, 1) for _ in range(1000)], None: [4.0, 8.0, 6.0, 1.0], "halves": [1.0] * 50 + [2.0] * 50,
    }
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None, float("nan")]] + [("empty", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.median for r in selection.medians(frame, "k", F.col("v")).collect()}
    assert got == {k: pytest.approx(median(vs), rel=1e-12) for k, vs in groups.items()}
    assert selection.medians(frame.where("false"), "k", F.col("v")).count() == 0
