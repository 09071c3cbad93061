"""Substring joins and coverage against plain Python."""

import random

from pyspark.sql import functions as F

from threatloom.operators import coverage as C


def test_substring_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda a, z: "".join(rng.choice("abAé🙂 \n.") for _ in range(rng.randrange(a, z)))
    texts = {word(0, 40) for _ in range(200)} | {"", "a" * 5000, "abab" * 2000}
    needles = {word(0, 9) for _ in range(300)} | {"", "a" * 4999, "zzzz", "z", ".", "\n"}
    found = C.substring_pairs(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == sorted((n, t) for n in needles for t in texts if n and n in t)


def test_overlaps_and_verdicts(spark):
    matches = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.75), (2, 7, 0.9), (3, 9, 0.5)], "article_id long, rule_id long, similarity double")
    behaviours = spark.createDataFrame([(1, "cmd.exe /c"), (1, "powershell"), (1, "x"), (1, "x"), (2, "lsass"), (2, None)], "article_id long, behaviour string")
    patterns = spark.createDataFrame([(7, "cmd.exe"), (7, "a powershell b"), (7, "xx"), (8, "shell"), (8, ""), (9, "q"), (9, None)], "rule_id long, pattern string")
    scores = spark.createDataFrame([(1, 80.0), (2, 70.0)], "article_id long, mean_score double")
    got = {(r.article_id, r.rule_id): r for r in C.coverage(matches, behaviours, patterns, scores).collect()}
    assert {k: (r.behaviours, r.matched, r.status) for k, r in got.items()} == {(1, 7): (3, 3, "covered"), (1, 8): (3, 1, "extend"), (2, 7): (1, 0, "new"), (3, 9): (0, 0, "new")}
    assert [got[k].confidence for k in ((1, 7), (1, 8), (2, 7), (3, 9))] == [0.9, round((0.75 + 1 / 3) / 2, 8), 0.55, 0.75]
    assert got[1, 7].reasoning == "Article behaviors are well covered by this rule (3/3 behaviors matched, 0.90 similarity) High hunt score (80.0) indicates valuable content."
    assert got[3, 9].reasoning == "Minimal overlap (0/0 behaviors matched, 0.50 similarity). Article represents new detection patterns."


def test_patterns(spark):
    row = spark.createDataFrame([(["*\\CMD.exe", "**a*b**", "cmd", "CMD"], "Suspicious use of Rundll32 by mshta")], "v array<string>, t string")
    assert row.select(C.pattern_values(F.col("v")), C.title_patterns(F.col("t"))).first() == (["\\cmd.exe", "a*b", "cmd"], ["suspicious", "rundll32", "mshta"])


def test_behaviours_of_articles(spark):
    chunks = spark.createDataFrame([(1, "a cmd here"), (1, "lsass and CMD"), (1, "calm"), (2, "calm")], "article_id long, chunk_text string")
    got = {r.article_id: r for r in C.article_behaviours(chunks, {"perfect": ["cmd", "lsass"], "good": ["here"], "negative": ["calm"]}).collect()}
    assert (got[1].perfect, got[1].good, got[1].chunks, got[1].largest_score) == (["cmd", "lsass"], ["here"], 3, 56.3)
    assert got[1].mean_score == (40.0 + 56.3 + 0) / 3 and (got[2].perfect, got[2].largest_score) == ([], 0.0)
