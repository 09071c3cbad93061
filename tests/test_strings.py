"""Text expressions without SQL, against plain Python."""

import re

from pyspark.sql import functions as F

from threatloom.functions import strings as S
from threatloom.operators import evaluation, rules

TEXTS = [None, "", "One. Two! Three?", "a " * 400, "word " * 90 + ". " + "next " * 60 + ".", "token = licensed TOKEN\nlicence secret", "x" * 600]


def test_summary(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string")
    got = {r.i: r.s for r in frame.select("i", S.summary(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        flat = " ".join((t or "").split())
        out = ""
        for s in (x.strip() for x in re.split(r"[.!?]+", flat)):
            if s:
                if len(f"{out} {s}".strip()) > 500:
                    break
                out = f"{out} {s}".strip()
        if not out:
            for w in flat.split():
                if len(f"{out} {w}".strip()) > 497:
                    break
                out = f"{out} {w}".strip()
            out += "..."
        assert got[i] == out


def test_span_metrics_match_greedily(spark):
    gold = spark.createDataFrame([(1, 0, 10), (1, 20, 30), (2, 0, 5), (4, 1990, 2010)], "article_id long, start long, end long")
    pred = spark.createDataFrame([(1, 0, 9), (1, 1, 10), (1, 21, 33), (3, 0, 5), (4, 1991, 2010)], "article_id long, start long, end long")
    got = {r.article_id: (r.tp, r.fp, r.fn, r.mean_overlap, r.mean_delta, r.precision, r.recall) for r in evaluation.span_metrics(gold, pred).collect()}
    assert got == {1: (2, 1, 0, round((0.9 + 9 / 13) / 2, 4), 0.5, 0.6667, 1.0), 2: (0, 0, 1, 0.0, 0.0, 0.0, 0.0), 3: (0, 1, 0, 0.0, 0.0, 0.0, 0.0), 4: (1, 0, 0, 0.95, -1.0, 1.0, 1.0)}


def test_score_clusters(spark):
    rows = [("k", i, s) for i, s in enumerate([0.9, 0.87, 0.84, 0.8, 0.5])] + [("l", 9, 0.1)]
    got = sorted((r.key, r.id, r.cluster) for r in rules.score_clusters(spark.createDataFrame(rows, "key string, id long, score double")).collect())
    assert got == [("k", 0, 1), ("k", 1, 1), ("k", 2, 2), ("k", 3, 2), ("k", 4, 3), ("l", 9, 1)]


def test_normal_form(spark):
    import unicodedata

    texts = [None, "", "Ñandú “Ça” – naïve… © ™ a_b? x;y:z. (w) #1", "e\u0301 \u0301 क् ½ ﬁ ß İ", "tab\t\n x  ", "a: \"'\", b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in frame.select("i", S.normal_form(F.col("t")).alias("f")).collect():
        t = texts[r.i] or ""
        for found, plain in S.PLAIN_CHARACTERS.items():
            t = t.replace(found, plain)
        t = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        assert r.f == " ".join(re.sub(r"[^\w\s.,;:?]", " ", t).split()).lower()
