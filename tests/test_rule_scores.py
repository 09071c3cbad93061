"""Scores of single rules, tokens, groups of observables, blocked titles, metadata and SQL functions."""

from datetime import datetime

from pyspark.sql import functions as F

from threatloom.functions import sql
from threatloom.operators import listings
from threatloom.operators import rule_scores as R


def test_huntability(spark):
    rules = spark.createDataFrame(
        [(1, ["attack.t1059"], "x" * 60 + " technique", "process_creation", "windows"), (2, [], "short", None, None), (3, None, None, "file_event", "windows"), (4, [], "", "dns", None)],
        "rule_id long, tags array<string>, description string, category string, product string",
    )
    values = spark.createDataFrame(
        [(1, "CommandLine", "*rundll32 javascript*", False), (1, "Image", "\\rundll32.exe", False), (1, "ParentImage", "\\winword.exe", False), (2, "CommandLine", "*", False), (2, "DestinationIp", "10.0.0.1", True), (2, "x", "evil.example.com", True), (4, "Command", None, False), (4, "Domain", "a.b.example.com", False)],
        "rule_id long, field string, value string, in_list boolean",
    )
    got = {r.rule_id: r for r in R.huntability(rules, values).collect()}
    assert (got[1].score, got[1].false_positive_risk, got[1].coverage_notes) == (9.0, "low", "Good coverage across all categories")  # each .exe counts as a host name
    assert (got[2].commandline_specificity, got[2].overfitting, got[2].false_positive_risk) == (0.0, 3.0, "high")
    assert got[2].coverage_notes == "Low command-line specificity; Telemetry feasibility concerns; High false-positive risk"
    assert (got[3].score, got[3].false_positive_risk, got[3].coverage_notes) == (0.0, "high", "No detection section")
    assert (got[4].commandline_specificity, got[4].telemetry_feasibility, got[4].overfitting) == (5.0, 5.0, 8.0)


def test_tokens_and_platforms(spark):
    rows = spark.createDataFrame([('*cmd.exe /c "WhoAmI" a=bb;<path> <ip x> 12', " Mac-OS "), (None, None), ("", "Win"), ("ab", "solaris")], "v string, p string")
    got = [(r.t, r.n) for r in rows.select(R.value_tokens(F.col("v")).alias("t"), R.platform_name(F.col("p")).alias("n")).collect()]
    assert got == [(["cmd.exe", "path", "whoami"], "macos"), ([], "unknown"), ([], "windows"), ([], "unknown")]


def test_review_summary(spark):
    assessed = spark.createDataFrame([(1, 5, 2, False), (2, 5, 0, False), (3, 0, 0, True), (4, 0, 0, False)], "rule_id long, evaluated long, sharing long, no_atoms boolean")
    best = spark.createDataFrame([(1, "c", 0.4), (2, None, 0.0)], "rule_id long, class string, similarity double")
    got = sorted(tuple(r) for r in R.review_summary(assessed, best).collect())
    assert got == [(1, 0.4, 5, 2, False, False), (2, None, 5, 0, True, True), (3, None, 0, 0, True, True), (4, 0.0, 0, 0, False, True)]


def test_blocked_titles(spark):
    rows = spark.createDataFrame([(1, "We are HIRING analysts"), (2, ""), (3, None), (4, "Lateral movement"), (5, "Our sale")], "article_id long, title string")
    got = sorted(tuple(r) for r in listings.title_blocked(rows, ("sale",)).collect())
    assert got == [(1, True, "hiring"), (2, True, None), (3, True, None), (4, False, None), (5, True, "sale")]


def test_enhanced(spark):
    html = "<h2>B <b>x</b></h2><h1>A</h1><img src=a><a href='x'>1</a><a name=y>2</a> Phishing APT " + "w " * 500
    rows = spark.createDataFrame([(1, html, datetime(2024, 2, 29, 12)), (2, "plain malware", None), (3, None, datetime(2025, 1, 1))], "article_id long, content string, published_at timestamp_ntz")
    got = {r.article_id: r for r in listings.enhanced(rows, as_of="2025-01-01 00:00:00").collect()}
    assert (got[1].threat_words, got[1].day_of_week, got[1].month, got[1].year, got[1].age_days) == (["phishing", "apt"], "Thursday", "February", 2024, 306)
    assert (got[1].reading_minutes, got[1].images, got[1].links, got[1].headings) == (2, 1, 1, ["A", "B x"])
    assert (got[2].threat_words, got[2].year, got[2].images, got[2].headings) == (["malware"], None, None, None) and got[3].threat_word_count == 0


def test_sql_functions(spark):
    names = sql.register(spark)
    assert {"hamming", "cosine", "page_links"} <= set(names)
    row = spark.sql("SELECT hamming(5L, 6L) AS h, cosine(array(1D, 0D), array(1D, 1D)) AS c, cosine(array(0D), array(1D)) AS z, token_jaccard('A b', 'b c') AS j, token_jaccard('', NULL) AS e, collapse_whitespace(' a \t b ') AS w, url_domain('HTTPS://A.b/x') AS d").first()
    assert (row.h, round(row.c, 6), row.z, round(row.j, 6), row.e, row.w, row.d) == (2, 0.707107, None, 0.333333, 1.0, "a b", "a.b")
    assert [r.target for r in spark.sql("SELECT * FROM page_links('https://a.b/c/', '<a href=\"d\">x</a>', 'a')").collect()] == ["https://a.b/c/d"]
