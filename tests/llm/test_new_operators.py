"""Ranked search, whitening and token output against brute force, with nulls, ties, repeated rows, clashing columns and empty tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threatloom.llm import queries, ranked_search, token_output, whitening

DATA = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")


def brute_rank(docs, items, k):
    terms = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    of = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in of), sum(len(t) for _, t in of)
    df = Counter(x for _, t in of for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for d, t in of:
            tf, m = Counter(t), 100 - 90 + (90 * len(t) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in set(terms(text)) if tf[x])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("postings", "leaf", "item_terms", "sent"), [(4_000_000, 4096, 1 << 16, 200_000), (300, 1, 40, 200_000), (2000, 8, 1 << 16, 3), (5000, 0, 1 << 16, 200_000)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, postings, leaf, item_terms, sent):
    for name, value in (("SHARD_POSTINGS", postings), ("LEAF", leaf), ("ITEM_TERMS", item_terms), ("SENT_TERMS", sent), ("SLICE_CELLS", 50), ("STEP_CELLS", 64)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Größe", "ÉTÉ", "été", "a_b", "C3po", "中文"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (None, "w1 w2"), (500, None), (501, ""), (502, "!!"), (503, "w59 " * 30_000)]
    items = [(i, text(12)) for i in range(6)] + [(6, docs[7][1]), (7, "nothing here"), (8, None), (9, ""), (10, "w0"), (10, "w0"), (None, "w1"), (11, " ".join(words))]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, item long").repartition(5)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = sorted(tuple(r) for r in ranked_search.rank(d, b).collect())
    assert found == brute_rank(docs, dict.fromkeys((i, t) for i, t in items if i is not None), 10)
    assert ranked_search.rank(d.where("false"), b).count() == 0 and ranked_search.rank(d, b.where("false")).count() == 0


def test_treaps_are_ordered_and_prune(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ranked_search, "LEAF", 64)
    n, lists = 20_000, []
    for share in (0.5, 0.3, 0.01, 0.002):
        lists.append(np.sort(rng.choice(n, int(n * share), replace=False)))
    impacts = [rng.integers(1, 1000, len(x)) for x in lists]
    starts = np.append(0, np.cumsum([len(x) for x in lists]))
    t = ranked_search.InvertedTreaps(np.concatenate(lists).astype(np.int32), np.concatenate(impacts), starts, n)
    for child in (t.left, t.right):
        has = child >= 0
        assert (t.impacts[child[has]] <= t.impacts[has]).all()
    assert (t.docs[t.left[t.left >= 0]] < t.docs[t.left >= 0]).all() and (t.docs[t.right[t.right >= 0]] > t.docs[t.right >= 0]).all()
    seen = []
    original = ranked_search.InvertedTreaps.scored
    monkeypatch.setattr(ranked_search.InvertedTreaps, "scored", lambda self, r, w: seen.append(int((r.end - r.begin).sum())) or original(self, r, w))
    weights = np.array([[3, 5, 40, 70]])
    _, docs, scores = t.search(np.arange(4)[None], weights, 10)
    dense = np.zeros(n, dtype=np.int64)
    for x, i, w in zip(lists, impacts, weights[0], strict=True):
        dense[x] += w * i
    want = np.lexsort((np.arange(n), -dense))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == dense[want].tolist()
    assert sum(seen) < sum(map(len, lists)) / 10  # most postings were never scored


def brute_whitened(rows, most=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = ((n * x - s) / n).astype(float)
    e, vectors = np.linalg.eigh(z.T @ z / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), z @ (vectors / np.sqrt(np.maximum(e, 1e-300)))[:, :most], e / e.sum()


@pytest.mark.parametrize(("tile", "block", "width"), [(128, 4096, 7), (3, 10, 7), (16, 64, 40)])
def test_whitening_equals_brute_force(spark, monkeypatch, tile, block, width):
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "ROW_BLOCK", block)
    rng = np.random.default_rng(width)
    v = (rng.normal(size=(300, width)) @ rng.normal(size=(width, width))).astype(np.float32)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)] + [(5, [float(c) for c in v[5]]), (None, [float(c) for c in v[6]])]
    odd = [(900, None), (901, []), (902, [None] + [1.0] * (width - 1)), (903, [math.nan] * width), (904, [math.inf] * width)]
    df = spark.createDataFrame([(i, r, 1, "x") for i, r in rows + odd], "vec_id long, embedding array<float>, n int, width string").repartition(3)
    n, deviation, whitened, explained = brute_whitened(rows)
    got = whitening.whiten(df).collect()
    k = min(32, width)
    assert len(got) == len(rows) * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by_id = {(r.vec_id, r.component): r for r in got}
    signs = np.sign([by_id[0, c + 1].whitened * whitened[0, c] for c in range(k)])
    for (i, _), d, w in zip(rows, deviation, whitened, strict=True):
        for c in range(k):
            r = by_id[i, c + 1]
            assert r.deviation == d and abs(r.whitened - signs[c] * w[c]) < 1e-7 and abs(r.explained / explained[c] - 1) < 1e-9
    assert whitening.whiten(df.where("false")).count() == 0 and whitening.whiten(df.where("vec_id >= 900")).count() == 0


def test_whitening_of_constant_mixed_and_huge_vectors(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(30)] + [(100 + i, [float(i), 2.0 * i * i]) for i in range(8)] + [(200, [1e30] * 4), (201, [-1e30] * 4)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    kinds = Counter((r.vec_id // 100, r.n) for r in got)
    assert kinds == {(0, 30): 60, (1, 8): 16, (2, 2): 2}  # the constant dimension and equal dimensions have no variance of their own
    assert all(r.identity_error < 1e-6 for r in got) and all(r.deviation is None for r in got if r.vec_id >= 200)
    assert whitening.whiten(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).count() == 0


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    n, deviation, whitened, explained = brute_whitened(rows)
    got = {(r.vec_id, r.component): r for r in queries.op12_whitening(spark, DATA).collect()}
    assert len(got) == len(rows) * 32
    for c in range(32):
        sign = np.sign(got[rows[0][0], c + 1].whitened * whitened[0, c])
        for (i, _), d, w in zip(rows, deviation, whitened, strict=True):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, d) and abs(r.whitened - sign * w[c]) < 1e-6 and abs(r.explained / explained[c] - 1) < 1e-6 and r.identity_error < 1e-4


def brute_tokens(docs):
    t, out, start = Tokenizer.from_file(WORD), [], 0
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard", [1 << 20, 500, 1])
def test_token_output_equals_the_library(spark, monkeypatch, shard):
    monkeypatch.setattr(token_output, "SHARD_IDS", shard)
    monkeypatch.setattr(token_output, "FREQUENT", 4)
    rows = [(i, f"the same words {i % 7} again and again, the same words") for i in range(0, 400, 2)]
    rows += [(-3, None), (1, ""), (3, "aaaa " * 5000), (5, "'" * 3000), (7, " ".join(f"wort{i % 997} Größe" for i in range(20_000))), (9, "中文 🙂"), (9, "中文 🙂"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, payload string").repartition(6)
    got = sorted((tuple(r) for r in token_output.digests(df, WORD).collect()), key=lambda r: r[1])
    assert got == brute_tokens(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert token_output.digests(df.where("false"), WORD).count() == 0


def test_repair_shrinks_and_reads_any_range(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 49_000, rng.integers(1, 6)).astype("<u4") for _ in range(300)]
    docs = [np.concatenate([words[i] for i in rng.integers(0, 300, rng.integers(1, 400))]) for _ in range(200)] + [np.full(999, 7, dtype="<u4"), np.array([70_000], dtype="<u4")]
    whole = np.concatenate(docs)
    payload = token_output.encoded(list(range(len(docs))), whole, np.array(list(map(len, docs))))
    shard = token_output.Shard(payload)
    assert len(payload) < whole.nbytes / 2.5 and shard.ids().tolist() == whole.tolist()
    assert len(shard.left) > 100 and int(shard.rule_sizes.max()) > 4  # rules of rules
    for a, b in rng.integers(0, len(whole), (50, 2)):
        assert shard.ids(a, b).tolist() == whole[a:b].tolist()
    assert all(shard.document(i).tolist() == d.tolist() for i, d in enumerate(docs))
    with pytest.raises(ValueError, match="damaged"):
        token_output.Shard(payload[:-1] + bytes([payload[-1] ^ 1]))
    with pytest.raises(ValueError, match="not a shard"):
        token_output.Shard(b"PAR1" + payload)


def test_token_output_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.op13_token_output(spark, DATA).collect()) == brute_tokens(rows)


def test_minhash_groups_equal_all_pairs_on_a_driver_table(spark):
    """op8 over sf0.01: every document's set size and component, against the intersections of all pairs of sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    shared = Counter()
    for held in holders.values():
        shared.update((a, b) for x, a in enumerate(held) for b in held[x + 1 :])
    head = {i: i for i in ids}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((root(a), root(b)))
            head[q] = p
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op8_minhash_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}
