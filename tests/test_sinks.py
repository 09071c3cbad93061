"""Keyed tables: conflicts, near copies, updates in place, and batches that fail and come again."""

import random

import pytest
from pyspark.sql import functions as F

from threatloom.functions.text import content_hash
from threatloom.operators.dedup import simhash
from threatloom.streaming import sinks

SCHEMA = "article_id long, title string, content string"
A = "a long enough text about lateral movement and powershell, told once"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(spark, folder, output):
    found = sinks.stored(spark, folder, output)
    return [] if found is None else sorted(tuple(r[c] for c in found.columns if c in ("article_id", "existing_id", "similar_id", "batch", "message")) for r in found.collect())


def test_inserts_with_conflicts_and_replays(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    first = frame(spark, [(1, "one", A), (2, "one again", A), (3, None, None), (4, "empty", "")])
    second = frame(spark, [(5, "x" * 60, A), (6, "near", A.replace("once", "twice")), (7, "new", "something else entirely, with other words in it")])
    sinks.insert(spark, folder, first, 0)
    assert rows(spark, folder, "articles") == [(1, 0), (3, 0)]
    assert rows(spark, folder, "conflicts") == [(2, 1, "Duplicate content hash: one again...", 0), (4, 3, "Duplicate content hash: empty...", 0)]
    # The writer fails behind the articles: nothing of the batch counts.
    put = sinks.put
    monkeypatch.setattr(sinks, "put", lambda r, f, output, b: put(r, f, output, b) if output == "articles" else (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError, match="disk full"):
        sinks.insert(spark, folder, second, 1)
    assert rows(spark, folder, "articles") == [(1, 0), (3, 0)] and sinks.commits(spark, folder) == [0]
    monkeypatch.setattr(sinks, "put", put)
    for _ in range(2):  # the second time it is a replay of a batch that counts already
        sinks.insert(spark, folder, second, 1)
        assert rows(spark, folder, "articles") == [(1, 0), (3, 0), (6, 1), (7, 1)]
        assert rows(spark, folder, "conflicts")[-1] == (5, 1, "Duplicate content hash: " + "x" * 50 + "...", 1)
    # An earlier batch that comes again doesn't see the later one.
    sinks.insert(spark, folder, first, 0)
    assert rows(spark, folder, "articles") == [(1, 0), (3, 0), (6, 1), (7, 1)]
    stored = {r.article_id: r for r in sinks.stored(spark, folder, "articles").collect()}
    hashes = {r.article_id: r.simhash for r in simhash(first.unionByName(second)).collect()}
    assert all(r.simhash == hashes[i] and r.bucket == hashes[i] & 15 and not r.analyse_chunks for i, r in stored.items())


def test_near_links_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(12)]
    made = lambda n, at: [(at + i, base[rng.randrange(12)] ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(0, 4)))) for i in range(n)]
    known, mine = made(150, 0), made(150, 1000)
    reps = {}
    for i, h in known + mine:
        reps.setdefault(h, i)
    old = dict(known)
    want = sorted((i, s, (h ^ g).bit_count()) for i, h in mine for g, s in reps.items() if (h ^ g).bit_count() <= 3 and (h ^ g) & 15 == 0 and (s in old or s < i))
    schema = "article_id long, simhash long"
    links = sinks.near_links(spark.createDataFrame(mine, schema), spark.createDataFrame(known, schema))
    assert sorted(tuple(r) for r in links.collect()) == want
    alone = sinks.near_links(spark.createDataFrame(mine, schema), None).collect()
    assert all(r.article_id > r.similar_id for r in alone) and alone


def test_matches_are_updated_in_place(spark, tmp_path):
    folder, schema = str(tmp_path / "m"), "article_id long, rule_id long, match_level string, chunk_id long, similarity double, status string"
    day = lambda d: F.expr(f"TIMESTAMP'2024-01-0{d} 00:00:00'")
    first = spark.createDataFrame([(1, 7, "article", None, 0.5, "new"), (1, 7, "article", None, 0.6, "extend"), (1, 7, "chunk", 3, 0.4, "new")], schema)
    second = spark.createDataFrame([(1, 7, "article", None, 0.3, "covered"), (2, 7, "article", None, 0.9, "new")], schema)
    assert sinks.matches(spark, folder) is None
    for _ in range(2):
        sinks.upsert_matches(spark, folder, first, 0, day(1))
    for _ in range(2):
        sinks.upsert_matches(spark, folder, second, 1, day(2))
        got = {(r.article_id, r.match_level, r.chunk_id): (r.similarity, r.status, r.created_at.day, r.updated_at.day) for r in sinks.matches(spark, folder).collect()}
        assert got == {(1, "article", None): (0.3, "covered", 1, 2), (1, "chunk", 3): (0.4, "new", 1, 1), (2, "article", None): (0.9, "new", 2, 2)}


def test_a_stream_is_inserted_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "t")
    for part in range(3):
        frame(spark, [(10 * part + i, "t", f"text {(part * 2 + i) % 5}") for i in range(4)]).coalesce(1).write.mode("append").parquet(source)
    for attempt in range(2):  # the second run has lost its checkpoint and starts over
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(sinks.inserter(folder, lambda r: r)).option("checkpointLocation", str(tmp_path / f"state{attempt}")).trigger(availableNow=True).start().awaitTermination()
        found = sinks.stored(spark, folder, "articles")
        assert found.count() == 5 and found.select(content_hash(F.col("content"))).distinct().count() == 5
        assert sinks.stored(spark, folder, "conflicts").count() == 7
