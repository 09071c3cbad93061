"""Each stage on a small table, and the whole."""

import corpus_pipeline
from threatloom.llm import components


def test_stages(spark, tmp_path):
    text = "plain words about nothing that anyone would mind at all in this place today"
    rows = [(i, f"{text} number {i} " + " ".join(f"u{i}x{k}" for k in range(30)), "en", "s", 0) for i in range(40)]
    rows += [(100, rows[0][1].upper(), "en", "s", 0), (101, rows[1][1] + " more", "en", "s", 0), (102, None, "en", "s", 0)]
    rows += [(103, "token = 'abcdefgh12345678' " + " ".join(f"v{k}" for k in range(30)), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/before-{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/before-{name}"), str(tmp_path))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            sizes[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(sizes["toxicity"]) == 44
    assert 0 not in sizes["exact_dedup"] and 100 in sizes["exact_dedup"]
    assert 101 not in sizes["near_dedup"] and 1 in sizes["near_dedup"] and len(sizes["near_dedup"]) == 42
    assert "abcdefgh12345678" not in sizes["secret_scan"][103]
    assert {r.doc_id for r in docs.collect()} == set(sizes["secret_scan"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 42


def test_stages_keep_one_row_of_repeated_ones_and_decide_by_text(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(1)), (1, text(1)), (2, text(2)), (3, text(3)), (3, text(2) + " more"), (4, text(4)), (4, text(4).upper()), (None, text(5)), (None, text(5)), (5, "short"), (5, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.drop_copies(spark, docs, "")
    assert once.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text.lower()) for r in once.collect())
    assert left == sorted({(i or 0, t.lower()) for i, t in rows})
    once.write.parquet(f"{tmp_path}/once")
    apart = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/once"), "")
    assert apart.columns == docs.columns
    left = [(r.doc_id, r.text.lower()) for r in apart.collect()]
    assert len(left) == len(set(left)) == 6 and (3, text(3)) in left
    assert len({(2, text(2)), (3, text(2) + " more")} & set(left)) == 1


def test_stages_pass_clashing_columns_and_empty_tables(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1), "a", 11, 21), (1, text(1), "b", 12, 22), (2, text(1).upper(), "c", 13, 23), (3, text(3), "d", 14, 24), (3, text(4), "e", 15, 25), (None, None, "f", 16, 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _id long, _n long")
    once = corpus_pipeline.drop_copies(spark, docs, "")
    assert sorted((r._sha, r._id, r._n) for r in once.collect()) == [("c", 13, 23), ("d", 14, 24), ("e", 15, 25), ("f", 16, 26)]
    apart = corpus_pipeline.drop_near_copies(spark, once, "")
    assert sorted((r._sha, r._id, r._n) for r in apart.collect()) == [("c", 13, 23), ("d", 14, 24), ("e", 15, 25), ("f", 16, 26)]
    assert corpus_pipeline.mask_secrets(spark, docs, "").columns == docs.columns
    spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    judged = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert judged.columns == docs.columns and {r._sha for r in judged.collect()} <= set("abcdef")
    assert corpus_pipeline.drop_toxic(spark, docs.where("false"), str(tmp_path)).count() == 0
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mask_secrets, corpus_pipeline.pack_windows):
        assert stage(spark, docs.where("false"), "").count() == 0


def test_toxic_rows_share_one_fate_and_ties_dont_crash(spark, tmp_path):
    bad, good = "you idiot trash loser stupid fool", "the river runs past quiet fields"
    rows = [(i, f"{bad if i % 2 else good} {i % 7}", "x") for i in range(200)]
    rows += [(1000 + i, f"{bad} 3", "x") for i in range(3)] * 2 + [(2000, f"{good} 3", "x")] * 3 + [(None, f"{bad} 5", "x"), (2001, None, "x"), (2002, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and not [t for _, t in left if t and "idiot" in t]
    assert left.count((2000, f"{good} 3")) == 3 and len([t for _, t in left if t and "river" in t]) == 103


def test_maps_and_ids_at_the_ends(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    docs = spark.sql("SELECT * FROM VALUES (7L, 'same text', map('a', 1)), (7L, 'same text', map('b', 2)), (8L, 'other', map('c', 3)) AS t(doc_id, text, m)")
    once = corpus_pipeline.drop_copies(spark, docs, "")
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == [7, 8]
    for ids in ((2**63 - 1, 5), (-(2**63), 5)):
        rows = [(ids[0], text(1)), (ids[0], text(2)), (ids[1], text(3)), (ids[1], text(1) + " more")]
        apart = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        left = [tuple(r) for r in apart.collect()]
        assert len(left) == 3 and {(ids[0], text(2)), (ids[1], text(3))} <= set(left)


def test_small_tables_of_links_take_few_tasks(spark):
    tracker, held = spark.sparkContext.statusTracker(), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few-tasks", "")
    try:
        got = {r.node: r.component for r in components.components(links).collect()}
    finally:
        for k in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(k, None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few-tasks")]
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    tasks = sum(s.numCompletedTasks for s in stages if s)
    assert 0 < tasks < 1500


def test_near_copies_are_dropped_by_broadcast_and_by_shuffle(spark, monkeypatch):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    docs = spark.createDataFrame([(k, text(k % 5) + " end" * (k > 4)) for k in range(8)], "doc_id long, text string")
    for most, join in ((10, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            left = corpus_pipeline.drop_near_copies(spark, docs, "")
            assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 4]
            assert join in left._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
