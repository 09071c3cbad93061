from pyspark.sql import functions as F

from threatloom.operators import labels
from threatloom.operators.chunks import filtered_chunks

TEXTS = [
    "Home\nRecent Copyright Home\n\nA model is here\n  second line  \nSign Up now\nlater",
    "Copyright first\nA model is here\nmore",
    "no such word\nCopyright",
    "model\nmore\nmore",
    "model Copyright\nmore",
    "\n \n",
    "",
    None,
]


def plain_trim(text, start, banner, footer, least):
    if not text:
        return text
    out, inside = [], False
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        inside = inside or any(w in line.lower() for w in start)
        if not inside and any(w in line for w in banner):
            continue
        if any(w in line for w in footer):
            break
        if inside:
            out.append(line)
    kept = "\n\n".join(out)
    return text if len(kept.strip()) < least else kept


def test_trimmed_lines(spark):
    rules = {"start": ["model"], "banner": ["Home"], "footer": ["Sign Up", "Copyright"], "least": 5}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", labels.trimmed_lines(F.col("t"), **rules).alias("x")).collect()}
    assert got == {i: plain_trim(t, **rules) for i, t in enumerate(TEXTS)}


def test_adjudication(spark):
    rows = [
        ('```json\n{"platforms": ["Win", "windows", "x"], "confidence": "HIGH"}\n```', ["windows"], "high"),
        ('so {"platforms": ["osx", "win"], "confidence": "sure"} it is', ["macos", "windows"], "medium"),
        ('{"platforms": []}', [], "low"),
        ("{broken", [], "low"),
        ("{broken}", [], "low"),
        ("", [], "low"),
        (None, [], "low"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    found, sure = labels.adjudication(F.col("t"), {"win": "windows", "windows": "windows", "osx": "macos"})
    got = {r.i: (r.p, r.c) for r in df.select("i", found.alias("p"), sure.alias("c")).collect()}
    assert got == {i: (r[1], r[2]) for i, r in enumerate(rows)}


def test_names_and_atoms(spark):
    df = spark.createDataFrame(
        [(["by Ann  Lee", "Author: Bob Writer", "ab", "x" * 100] + ["Name %d" % i for i in range(9)], ["C++", " Red-Team ", "red-team", "a", "!!", "y" * 51], "f|re|i|v"), (None, None, None)],
        "a array<string>, t array<string>, x string",
    )
    first, empty = df.select(labels.author_names(F.col("a")), labels.tag_names(F.col("t")), labels.atom_text(F.col("x"))).collect()
    assert list(first) == [["Ann Lee", "Bob", "Name 0", "Name 1", "Name 2"], ["c", "red-team"], "f|re:v"]
    assert list(empty) == [None, None, None]


def test_filtered_chunks_keep_articles_without_any(spark):
    cut = spark.createDataFrame([(1, 1, "b token = 1"), (1, 0, "a token = 1"), (1, 2, "idiot"), (2, 0, "plain")], "article_id long, chunk int, chunk_text string")
    got = {r.article_id: (r.chunks, r.kept, r.kept_chars, r.kept_text) for r in filtered_chunks(cut, threshold=0.5).collect()}
    assert got == {1: (3, 2, 22, "a token = 1\n\nb token = 1"), 2: (1, 0, 0, "")}


def test_trimmed_lines_are_cut_once(spark):
    """White space is no pattern, and the lines of a text are split in one place of the plan only; a next-line sign isn't the end of a line."""
    df = spark.createDataFrame([("  the start \t\x0b\r\nab \x85\n\n" + "x" * 120 + "\nend",), (None,)], "t string")
    found = df.select(labels.trimmed_lines(F.col("t"), start=["the"], banner=["b"], footer=["end"]).alias("x"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "regexp_replace" not in plan
    assert [r.x for r in found.collect()] == ["the start\n\nab \x85\n\n" + "x" * 120, None]
