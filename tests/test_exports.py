import pytest
from pyspark.sql import functions as F

from threatloom.operators import changes, retrieval
from threatloom.sources import exports


def test_files_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", text', ["x", "y"]), (2, None, [])], "id int, t string, tags array<string>")
    exports.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == [("1", 'a "quoted", text', "x; y"), ("2", None, None)]
    exports.write_json(rows, str(tmp_path / "json"))
    again = spark.read.schema(rows.schema).json(str(tmp_path / "json"))
    assert sorted(map(tuple, again.collect())) == [(1, 'a "quoted", text', ["x", "y"]), (2, None, [])]
    with pytest.raises(Exception, match="exists"):
        exports.write_json(rows, str(tmp_path / "json"))


def test_read_only_sql(spark):
    spark.range(500).select(F.repeat(F.lit("x"), 400).alias("t")).createOrReplaceTempView("many_rows")
    got = exports.read_only(spark, "SELECT t, 1 AS `a b` FROM many_rows").collect()
    assert len(got) == 200 and len(got[0].t) == 300 and got[0]["a b"] == "1"
    for bad in ("", "DROP TABLE many_rows", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT 1; SELECT 2", "SELECT 1 -- x"):
        with pytest.raises(ValueError, match="read-only"):
            exports.read_only(spark, bad)


def test_training_rows_are_taken_once(spark):
    a = spark.createDataFrame([(1, "k", "train", None), (2, "k", "train", True), (3, "k", "eval", True), (4, "o", "train", False)], "article_id int, annotation_type string, usage string, used boolean")
    assert [r.article_id for r in exports.training_rows(a, kind="k", usage="train").collect()] == [1]
    assert [r.article_id for r in exports.training_rows(a, kind="k", usage="eval").collect()] == [3]
    taken, marked = changes.take_unused(a, "used")
    assert sorted(r.article_id for r in taken.collect()) == [1, 4] and all(r.used for r in marked.collect())


def test_sync_keeps_owned_values(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "mine"), ("c", 3, "x")], "k string, v int, o string")
    new = spark.createDataFrame([("a", 10, "seed"), ("b", 20, "seed"), ("d", 40, "seed")], "k string, v int, o string")
    plan = lambda **kw: sorted(map(tuple, changes.sync_plan(old, new, "k", updated=["v"], owned=["o"], **kw).collect()))
    assert plan() == [("a", "update", 10, "seed"), ("b", "update", 20, "mine"), ("c", "delete", 3, "x"), ("d", "insert", 40, "seed")]
    assert plan(new_only=True, remove_missing=False) == [("a", "keep", 1, None), ("b", "keep", 2, "mine"), ("c", "keep", 3, "x"), ("d", "insert", 40, "seed")]


def test_valid_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, None]), (3, [1.0, float("nan")]), (4, [float("inf"), 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    assert [r.i for r in df.where(changes.valid_vector(F.col("v"), 2)).collect()] == [0]


def test_best_per_key_and_related(spark):
    hits = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 1, 0.4), (2, 9, 0.1)], "article_id int, chunk int, similarity double")
    assert sorted(map(tuple, retrieval.best_per(hits, "article_id", tie="chunk").collect())) == [(1, 2, 0.5), (2, 9, 0.1)]
    found = spark.createDataFrame([(1, "T1", "Impact here", 0.9), (2, "T2", "impact and discovery", 0.8)], "rank int, title string, content string, similarity double")
    assert [tuple(r) for r in retrieval.related_phrases(found, 5).collect()] == [("impact", 0.9, "T1"), ("discovery", 0.8, "T2")]
    assert [tuple(r) for r in retrieval.related_phrases(found, 1).collect()] == [("impact", 0.9, "T1")]
