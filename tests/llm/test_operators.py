"""Small cases with brute force beside them: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threatloom.llm import bpe, chat_format, exact_dedup, license_scan, minhash_dedup, packing, secret_scan, suffix_dedup, topk_search, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"wort{i % 997} Größe" for i in range(20_000))
TEXTS = [
    None, "", "a", "Hello  world\n\n it's <|endoftext|>done", "naïve 中文字 🙂 \x1c\x85 end", LONG, "same text here", "same text here", "SAME text here",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(TEXTS)] + [(6, "same text here", "x", "y", "z"), (None, "no id", "x", "y", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, ids string, _hash string")


def empty(docs):
    return docs.where("false")


def test_bpe_equals_the_library(docs):
    t = Tokenizer.from_file(BYTE)
    for r in bpe.encode(docs, BYTE, decoded=True).collect():
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False) == text
    assert bpe.digests(empty(docs), BYTE).count() == 0
    again = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert len(again) == docs.count()


def test_bpe_fragments_never_cross_a_token():
    b = bpe.loaded(BYTE)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab é中'\n 1!<|>"), 40)) for _ in range(300)] + ["q" * 3000, "ab" * 900]
    t = Tokenizer.from_file(BYTE)
    assert [x.tolist() for x in b.encode_all(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_license_scan(docs, spark):
    text = "MIT License. x\nThe APACHE license, apache license; GNU General Public License v3\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause"
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    words = re.findall(license_scan.WORD, text.lower())
    starts = [i for i in range(len(words)) for p in license_scan.BASE if words[i : i + len(p.split())] == p.split()]
    assert (r[0].n_words, r[0].n_base, r[0].first_word, r[0].last_word) == (len(words), len(starts), min(starts), max(starts))
    assert r[0].base_labels == "apache,gpl,mit" and r[0].labels == "apache,bsd,gpl,mit" and 0 < r[0].score < 1
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].base_labels, r[1].labels, r[1].score) == (0, 0, None, "", "", 0)
    assert license_scan.to_polish("mit or apache-2.0 and bsd") == ["mit", "apache-2.0", "bsd", "and", "or"]
    assert license_scan.to_polish("mit or") is None and license_scan.to_polish("(mit") is None
    assert license_scan.evaluate(["gpl-3.0", "mit", "or"]) == ({"gpl", "mit"}, 1.0)
    assert license_scan.evaluate(["licenseref-acme"]) == ({"licenseref-acme"}, None) and license_scan.evaluate(["foo-2.0", "mit", "and"]) == ({"foo-2.0", "mit"}, 1.0)
    assert license_scan.evaluate(["see"]) == (set(), None) and license_scan.evaluate(["cc-by-nc-4.0"]) == ({"cc"}, 0.1) and license_scan.evaluate(["mitre-x"]) == (set(), None)
    assert license_scan.evaluate(["agpl-3.0", "epl-2.0", "classpath-exception-2.0", "with", "or"]) == ({"agpl", "epl"}, 0.8)
    assert license_scan.scan_licenses(docs).count() == docs.count() and license_scan.scan_licenses(empty(docs)).count() == 0


def test_license_scan_equals_brute_force_on_driver_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    phrases = {**license_scan.BASE, **license_scan.MORE}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in license_scan.scan_licenses(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        places = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in phrases if p.split()[0] in words}
        base = sorted(i for p in license_scan.BASE for i in places.get(p, []))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(base), base[0] if base else None, base[-1] if base else None)
        assert r.base_labels == ",".join(sorted({license_scan.BASE[p] for p in license_scan.BASE if places.get(p)}))
        assert {phrases[p] for p, at in places.items() if at} <= set(r.labels.split(","))


def brute_removed(texts, w):
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                cover[i : i + w] = True
        kept = bytes(b for b, c in zip(t, cover, strict=False) if not c)
        out.append((len(t), int(cover.sum()), int((cover & ~np.append(False, cover[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "shard"), [(1, 5000), (3, 1 << 20), (4000, 1 << 20), (4000, 3000)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 10)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage, line = word(450), word(230)
    texts = [None, "", "short", word(300), "z" * 5000, "ab" * 1250, "abc" * 900 + word(50) + "bca" * 80, passage, passage, line * 3, word(3000), "x" * 199, "x" * 199, "y" * 200]
    texts += [word(150) + passage[40:] + word(90) for _ in range(6)] + [word(120) + line + word(60) + passage[:260] for _ in range(5)] + [texts[3][:210] + "z" * 230]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, word(250)), (8, passage), (9, texts[10][700:1000])]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n long, k1 string")
    got = sorted((tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame)).collect()), key=str)
    expected = brute_removed([(t or "").encode() for _, t in rows], 200)
    assert got == sorted(((r[0], *e) for r, e in zip(rows, expected, strict=True)), key=str)
    assert suffix_dedup.remove_repeats(frame.where("false")).count() == 0


def test_suffix_dedup_sorts_only_what_may_repeat(monkeypatch):
    rng = np.random.default_rng(6)
    some = lambda n: bytes(rng.choice(np.frombuffer(b"abcdefgh ", dtype=np.uint8), n))
    anchor, line, sorted_ = some(48), some(100), []
    texts = [some(152) + anchor + some(152) for _ in range(50)] + [some(60) + line + anchor + some(int(n)) for n in (60, 90)] + [(some(101) + anchor) * 4]
    key = int(suffix_dedup.gram_hashes(np.frombuffer(anchor, dtype=np.uint8), 48).view(np.int64)[0])
    assert suffix_dedup.shares_core(texts[:50], np.full(50, key), 200).sum() == 0
    assert suffix_dedup.shares_core(texts, np.full(len(texts), key), 200).sum() == 1  # two share 148 bytes, which is no window
    texts[51] = texts[50][58:260] + some(40)
    rows = pd.DataFrame([(i, i, key, 0, i == 52, t) for i, t in enumerate(texts)], columns=["id", "k1", "fp", "start", "again", "piece"])
    repeats = suffix_dedup.repeats_of_shard
    monkeypatch.setattr(suffix_dedup, "repeats_of_shard", lambda pieces, *rest: sorted_.extend(pieces) or repeats(pieces, *rest))
    got = suffix_dedup.spans_of_shard(rows, 200)
    assert sorted(sorted_) == sorted(texts[50:])
    assert sorted(zip(got.id, got.a, got.z, strict=True)) == sorted((rows.id[w], a, z) for w, a, z in zip(*repeats(texts, np.zeros(len(texts), dtype=bool), 200), strict=True))
    assert {50, 51, 52} == set(got.id)


@pytest.mark.parametrize("sent", [0, 100])
def test_suffix_dedup_sends_marks_of_hot_pieces(spark, monkeypatch, sent):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage, line = word(450), word(230)
    texts = [word(150) + passage + word(90) for _ in range(6)] + [word(120) + line + word(60) for _ in range(2)]
    plans, cut_rows = [], suffix_dedup.piece_rows
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 3)
    monkeypatch.setattr(suffix_dedup, "SENT_TEXTS", sent)
    monkeypatch.setattr(suffix_dedup, "piece_rows", lambda texts: plans.append(texts._jdf.queryExecution().optimizedPlan().toString()) or cut_rows(texts))
    got = sorted(tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect())
    assert got == [(i, *e) for i, e in enumerate(brute_removed([t.encode() for t in texts], 200))]
    assert ["strategy=broadcast" in p for p in plans] == [False, sent > 0]


def test_suffix_dedup_of_long_periodic_texts(spark):
    rng = np.random.default_rng(4)
    unit = "".join(rng.choice(list("abcdefgh"), 301))
    texts = ["z" * 1_000_000, "ab" * 200_000, unit * 1500, "plain " * 40 + "z" * 150, "b" + unit]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame)).collect())
    assert got == [(i, *e) for i, e in enumerate(brute_removed([t.encode() for t in texts], 200))]
    for t in texts:
        _, starts, sizes, _ = suffix_dedup.cut(np.frombuffer(t.encode(), dtype=np.uint8), 200)
        assert sizes.sum() < 5 * len(t) and sizes.max() <= 368 and (starts[1:] == starts[:-1] + sizes[:-1] - 199).all()


def test_exact_dedup(docs):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == docs.count()
    same = [r for r in rows if r.doc_id in (6, 7, 8)]
    assert len(same) == 4 and all((r.keep_id, r.group_size) == (8, 4) for r in same) and [r.kept for r in sorted(same, key=lambda r: r.doc_id)] == [False] * 3 + [True]
    blank = [r for r in rows if r.doc_id in (0, 1)]
    assert all(r.keep_id == 1 and r.group_size == 2 and r.text_sha256 == hashlib.sha256(b"").hexdigest() for r in blank)
    assert exact_dedup.exact_groups(empty(docs)).count() == 0


def test_exact_dedup_survives_hash_collisions(docs, monkeypatch):
    real = exact_dedup.hashed
    monkeypatch.setattr(exact_dedup, "hashed", lambda d: real(d).withColumn("_hash", exact_dedup.F.lit("one")))
    collided = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    monkeypatch.undo()
    assert collided == {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    bad = ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[3], words[9] = rng.choice(bad, 2)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic), 1))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "nothing known", "en"), (None, "you idiot", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (5, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, known)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = dict((i, y) for i, y, _ in labels)
    for i in range(400):
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if out[i].held_out:
            assert out[i].predicted == truth[i]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert out[1000].score == out[1001].score < 0.3 and out[None].predicted == 1 and not out[None].held_out and out[None].evidence
    assert toxicity.score(docs.where("false"), model).count() == 0
    nothing = toxicity.fit(docs, known.where("false"))
    assert toxicity.score(docs, nothing).where("score between 0 and 1").count() == docs.count()


@pytest.mark.parametrize("every, insults", [(2, 5), (10, 2)])
def test_toxicity_learns_from_few_rows_and_from_as_many_toxic_ones(spark, every, insults):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
        if i % every == 0:
            words[3 : 3 + insults] = rng.choice(["idiot", "scum", "moron"], insults)
        rows.append((i, " ".join(words), int(i % every == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, docs)).collect()}
    assert all(r.evidence for r in out.values()) and len({r.score for r in out.values()}) > 30
    for i, _, y in rows:
        if every == 2 or not out[i].held_out:
            assert out[i].predicted == y


@pytest.mark.parametrize("frequent", [2, 16, 10_000])
def test_block_max_index_is_exact(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    monkeypatch.setattr(toxicity, "REVIEWS", range(0, 10, 2))
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((300, 60)) < rng.random(60) ** 2, rng.integers(1, 4, (300, 60)), 0)
    dense[:, 59] = 1
    dense[7], dense[9] = dense[8], dense[8]
    text, term = np.nonzero(dense)
    vectors = toxicity.Terms(300, text, term, dense[text, term]).weighted(np.linspace(0.2, 1.5, 60))
    index = toxicity.BlockMaxIndex(list(range(300)), [i % 2 for i in range(300)], vectors, 60)
    full = np.zeros((300, 60))
    full[vectors.text, vectors.term] = vectors.n
    full = full[index.ids]
    sims = np.round(full @ full.T, 9)
    some = vectors.text < 50
    queries = toxicity.Terms(50, vectors.text[some], vectors.term[some], vectors.n[some])
    where = np.argsort(index.ids)[:50]
    for skip in (None, where):
        for q, (at, s) in enumerate(index.nearest(queries, 7, skip)):
            row = sims[where[q]].copy()
            if skip is not None:
                row[where[q]] = -1
            expected = np.lexsort((np.arange(300), -row))[:7]
            assert at.tolist() == expected.tolist() and np.allclose(s, row[expected])


def test_toxicity_scores_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(2, 9, 300)]
    texts = {i: " ".join(rng.choice(vocabulary, int(rng.integers(1, 60)))) + (" Idiot" * int(i % 4 == 0)) for i in range(120)} | {500: None, 501: "zzzz", 502: ""}
    labels = {i: int(i % 4 == 0) for i in range(120)}
    docs = spark.createDataFrame([*texts.items(), (3, "zz of a repeated id")], "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {(r.doc_id, r.score): r for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}

    def terms(t):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            out.update([w, *(w[:n] + "*" for n in toxicity.PREFIXES if len(w) > n)])
        return out

    learnt = {i: terms(texts[i]) for i in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    df = Counter(t for _, text in [*texts.items(), (3, "zz of a repeated id")] for t in terms(text))
    prior = (sum(labels[i] for i in learnt) + 0.5) / (len(learnt) + 1)

    def model(rows):
        """Weights and unit vectors that some of the learnt rows give."""
        n1, n0 = (Counter(t for i in rows if labels[i] == y for t in learnt[i]) for y in (1, 0))
        share = sum(labels[i] for i in rows) / len(rows)
        weight = {}
        for t in df:
            m = n1[t] + n0[t]
            chi = (n1[t] - m * share) ** 2 / max(m * share, 1e-9) + (n0[t] - m * (1 - share)) ** 2 / max(m * (1 - share), 1e-9)
            if any(t in c for c in learnt.values()):
                weight[t] = (np.log((1 + len(texts) + 1) / (1 + df[t])) + 1) * (1 + chi) / (30 + chi)

        def unit(c):
            v = {t: (1 + np.log(n)) * weight[t] for t, n in c.items() if t in weight}
            norm = sum(x * x for x in v.values()) ** 0.5
            return {t: x / norm for t, x in v.items()}

        units = {i: unit(learnt[i]) for i in rows}

        def vote(c):
            v = unit(c)
            near = sorted((-round(sum(x * u.get(t, 0) for t, x in v.items()), 9), i) for i, u in units.items())
            near = [(-s, i) for s, i in near[:15] if s < 0]
            return (sum(s * s * labels[i] for s, i in near) + 0.05 * prior) / (sum(s * s for s, _ in near) + 0.05), [i for _, i in near], near

        return vote

    order = sorted(learnt)
    votes, judged = [], []
    for half in (0, 1):
        vote = model(order[1 - half :: 2])
        votes += [vote(learnt[i])[0] for i in order[half::2]]
        judged += [labels[i] for i in order[half::2]]
    curve = toxicity.logistic(toxicity.logit(np.array(votes)), np.array(judged, dtype=float))
    vote = model(order)
    for i, text in texts.items():
        share, near, sims = vote(terms(text))
        expected = 1 / (1 + np.exp(-(curve[0] * toxicity.logit(share) + curve[1])))
        r = min((r for (d, _), r in got.items() if d == i), key=lambda r: abs(r.score - expected))
        assert abs(r.score - expected) < 1e-6
        # Exactly the nearest, but for the order of similarities that are equal to nine places.
        assert len(r.evidence) == len(near) and len(set(near) ^ set(r.evidence)) <= 2 * sum(abs(s - sims[-1][0]) < 2e-9 for s, _ in sims if sims)
        clear = {i for s, i in sims if s > sims[-1][0] + 2e-9}
        assert clear <= set(r.evidence)


def test_secret_scan(docs, spark):
    key = "AKIA" + "ABCDEFGH12345678"
    text = f"é pass{'word'} = 'Abc12345xyz' token: ab secret=api_key: zzzzzzzzzz {key} AKIASHORT 0123456789abcdef0123456789abcdef"
    frame = spark.createDataFrame([(1, text, "q"), (2, None, "q"), (3, "plain words only", "q")], "doc_id long, text string, spans string")
    r = {x.doc_id: x for x in secret_scan.scan_secrets(frame).collect()}
    base = []
    for kind, m in enumerate((re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))):
        for x in m.finditer(text):
            if len(x[1] if kind == 0 else x[0]) >= (8, 16, 32)[kind]:
                base.append((x.start(), kind, x.end()))
    expected = ",".join(f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in sorted(base))
    assert r[1].base_spans == expected and (r[1].n_access, r[1].n_hex) == (1, 1)
    assert set(expected.split(",")) <= set(r[1].spans.split(","))
    assert r[2].spans == r[3].spans == "" and r[2].n_assign == 0
    masked = {x.doc_id: x.text for x in secret_scan.redact(frame).collect()}
    assert key not in masked[1] and "[SECRET]" in masked[1] and masked[2] is None and masked[3] == "plain words only"
    assert secret_scan.scan_secrets(docs).count() == docs.count() and secret_scan.scan_secrets(empty(docs)).count() == 0


def test_secret_network_sees_runs_that_base_spans_cover_in_part():
    class Sure:
        threshold = 0.5

        def passes(self, data, starts, ends):
            return np.ones(len(starts), dtype=bool)

        def probability(self, codes):
            return np.ones(len(codes))

    Sure.sieve = Sure.network = Sure()

    inner, access = "0123456789abcdef" * 2, "AKIA" + "ABCDEFGH12345678"
    joined = "/".join(["Zq7" + access, *["x" * 9 + f"AKIA{i}ABCDEFGH1234567" for i in range(9)], "tail9QWERTY"])
    for run in (f"Zx9QwErTy{inner}Lm4PoIu", f"{inner}/Zx9QwErTy", f"{access}/aB3dE5gH7jK9mN1pQ3sT", joined):
        text = f"see {run} here"
        spans = secret_scan.find_all([text], Sure())[0]
        assert (4, 3, 4 + len(run)) in spans and [s for s in spans if s[1] < 3] == secret_scan.base_spans(text)
    for run in (inner, access, "password=Abc12345xyzAbc12345", "token=" + inner):
        text = f"see {run} here"
        assert secret_scan.find_all([text], Sure())[0] == secret_scan.base_spans(text)


def test_secret_network_judges_every_candidate_in_its_context():
    """Every uncovered run reaches the network, plain words and numbers too, with the characters before it."""
    texts = ["plainword 12345678 é中🙂 another-word", None, "", "x" * 100 + " tail/word token=Abc12345xyz"]
    seen = []

    class Judge:
        threshold = 0.5

        def passes(self, data, starts, ends):
            return np.zeros(len(starts), dtype=bool)

        def probability(self, codes):
            seen.extend(np.array(codes)[:, : secret_scan.CONTEXT + secret_scan.TILE])
            return np.ones(len(codes))

    Judge.sieve = Judge.network = Judge()
    spans = secret_scan.find_all(texts, Judge())
    assert [(a, z) for a, k, z in spans[0] if k == 3] == [(0, 9), (10, 18), (23, 35)] and spans[1] == spans[2] == []
    assert [(a, z) for a, k, z in spans[3] if k == 3] == [(0, 100), (101, 110)]
    parts = [p for text, found in zip(texts, spans, strict=True) for a, k, z in found if k == 3 for p in secret_scan.tiles(text, a, z)]
    want = secret_scan.encode([(before, inner, "") for before, inner, _ in parts])[:, : secret_scan.CONTEXT + secret_scan.TILE]
    assert np.array_equal(np.array(seen), want)


def test_secret_network_sees_what_stands_behind_a_run():
    """The judged codes hold it, for every tile and at the end of a text; filters, gradients and training use it."""
    texts = ["plainword 12345678 é中🙂 another-word", "x" * 100 + " tail/word, next", "only-this"]
    seen = []

    class Judge:
        threshold = 0.5

        def probability(self, codes):
            seen.extend(np.array(codes))
            return np.ones(len(codes))

    Judge.network = Judge()
    spans = secret_scan.find_all(texts, Judge())
    parts = [p for text, found in zip(texts, spans, strict=True) for a, _, z in found for p in secret_scan.tiles(text, a, z)]
    codes = secret_scan.encode(parts)
    assert [p[2] for p in parts[3:6]] == ["x" * 24, "x" * 4 + " tail/word, next", " tail/word, next"] and np.array_equal(np.array(seen), codes)

    network = secret_scan.CharCNN(np.random.default_rng(1), np.zeros((len(secret_scan.ALPHABET) + 2,) * 2))
    network.p["c"] = np.random.default_rng(3).normal(0, 0.1, secret_scan.FILTERS)
    assert np.allclose(network.forward(codes)[0], network.logits(codes), atol=1e-4)
    y = np.arange(len(codes)) % 2.0
    loss = lambda: float(np.mean(np.logaddexp(0, network.forward(codes)[0]) - y * network.forward(codes)[0]))
    gradients = network.gradients(codes, y)
    for name, at in (("h", (3 * secret_scan.FILTERS + 5, 3)), ("w", (7, 4)), ("c", (2,)), ("e", (secret_scan.CODE["t"], 1))):
        kept, sides = network.p[name][at], []
        for step in (1e-5, -1e-5):
            network.p[name][at] = kept + step
            sides.append(loss())
        network.p[name][at] = kept
        assert abs((sides[0] - sides[1]) / 2e-5 - gradients[name][at]) < 1e-6, name

    ends = [("see ", "Abcdefgh", " secret!" if i % 2 else " nothing") for i in range(64)]
    y = np.arange(64) % 2.0
    network.train(secret_scan.encode(ends), y, np.random.default_rng(2), epochs=60, batch=16)
    assert ((network.logits(secret_scan.encode(ends)) > 0) == (y > 0)).all()


def test_every_run_of_key_characters_is_a_candidate():
    rng = np.random.default_rng(2)
    for _ in range(200):
        text = "".join(rng.choice(list("aZ9+/_.=-") * 3 + list(" é\n中🙂,"), 60))
        data = np.frombuffer(b"\n" + text.encode() + b"\n", dtype=np.uint8)
        starts, ends = secret_scan.runs(data)
        raw = text.encode()
        assert [raw[a - 1 : z - 1].decode() for a, z in zip(starts, ends, strict=True)] == [m[0] for m in re.finditer(r"[A-Za-z0-9+/_.=-]{8,}", text)]


def test_secret_network_finds_planted_kinds_in_driver_texts(spark):
    """Ten kinds of secrets, each planted into 150 texts of the tables: recall of each, and what is found in the texts as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    model = secret_scan.fit(docs)
    r = random.Random(5)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum, low_hex = string.ascii_letters + string.digits, "0123456789abcdef"
    kinds = {
        "alnum32": lambda: pick(alnum, 32), "alnum20": lambda: pick(alnum, 20), "alnum16": lambda: pick(alnum, 16), "hex28": lambda: pick(low_hex, 28), "uuid": lambda: "-".join(pick(low_hex, n) for n in (8, 4, 4, 4, 12)),
        "letters40": lambda: pick(string.ascii_letters, 40), "lower32": lambda: pick(string.ascii_lowercase, 32), "digits24": lambda: pick(string.digits, 24), "prefix": lambda: "ghp_" + pick(alnum, 36), "base64": lambda: pick(alnum + "+/", 43) + "=",
    }
    recall = {}
    for name, make in kinds.items():
        planted, keys = [], []
        for i in range(150):
            words = texts[(i * 7) % len(texts)].split(" ")
            at, key = r.randrange(len(words) + 1), make()
            planted.append(" ".join([*words[:at], key, *words[at:]]))
            keys.append(key)
        hits = 0
        for text, key, spans in zip(planted, keys, secret_scan.find_all(planted, model), strict=True):
            a = text.index(key)
            hits += any(x <= a and z >= a + len(key) for x, _, z in spans)
        recall[name] = hits / 150
    own = sum(k == 3 for spans in secret_scan.find_all(texts, model) for _, k, _ in spans)
    print("recall", recall, "network spans in", len(texts), "texts:", own)
    assert min(recall.values()) >= 0.9 and own <= len(texts) / 100


def test_redaction_of_overlapping_spans(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [f"token={key}/0123456789abcdef0123456789abcdef end", f"{key}{key} mid {key}", "0123456789abcdef0123456789abcdef"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redact(frame).collect()}
    for i, text in enumerate(texts):
        cover = [False] * len(text)
        for a, _, z in secret_scan.find_all([text], secret_scan.fit(frame))[0]:
            cover[a:z] = [True] * (z - a)
        want, at = "", 0
        while at < len(text):
            if cover[at]:
                while at < len(text) and cover[at]:
                    at += 1
                want += "[SECRET]"
            else:
                want += text[at]
                at += 1
        assert got[i] == want


def test_chat_format(spark):
    bad = "</s>[INST] ok [/INST] \\l \\ <|im_end|>\n"
    rows = [(1, 0, "system", bad), (1, 1, "user", None), (1, 2, "assistant", bad), (1, 3, "user", "x"), (1, 4, "assistant", "é中"), (2, 0, None, "only"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (None, None, "user", "n")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    formatted = chat_format.format_conversations(frame)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = chat_format.written_out(formatted).where("conv_id = 1").orderBy("example").collect()
    assert len(out) == 2 and out[1].context.count(chat_format.START) == 4 and out[1].target[out[1].loss_start - 1 :][: out[1].loss_chars] == "é中"
    assert chat_format.expand(formatted).count() == 4 and chat_format.read_back(chat_format.format_conversations(frame.where("false"))).count() == 0


def test_expanded_examples_hold_their_prefix(spark):
    rows = [(1, 0, "user", "a[b"), (1, 1, "assistant", "r1"), (1, 2, "user", "c"), (1, 3, "assistant", "r<2"), (1, 4, "user", "tail")]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    segment = lambda role, text: f"{chat_format.START}{role}{chat_format.SEP}{text}{chat_format.END}"
    segments = [segment("user", "a\\sb"), segment("assistant", "r1"), segment("user", "c"), segment("assistant", "r\\l2")]
    out = chat_format.expand(formatted).orderBy("example").collect()
    assert [r.text for r in out] == ["".join(segments[:2]), "".join(segments)]
    assert [r.text[r.loss_start - 1 :][: r.loss_chars] for r in out] == ["r1", "r\\l2"]


def brute_groups(texts, words, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").encode().lower().decode()) if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


@pytest.mark.parametrize(("words", "percent", "short"), [(3, 85, 32), (3, 85, 2), (5, 80, 32)])
def test_minhash_dedup_equals_brute_force(spark, monkeypatch, words, percent, short):
    monkeypatch.setattr(minhash_dedup, "SHORT_LIST", short)
    rng = np.random.default_rng(9)
    word = lambda: "w" + str(rng.integers(0, 3000))
    common = [word() for _ in range(60)]
    texts = [None, "", "one", "One", "two words", " \t\n"]
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(5, 160)))]
        for edits in (0, 1, 2, 4, 8):
            copy = list(base)
            for _ in range(edits):
                copy[int(rng.integers(0, len(copy)))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(int(rng.integers(2, 60)))] + common) for _ in range(40)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, sketch int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(frame, words=words, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts, words, percent)
    assert minhash_dedup.near_groups(frame.where("false")).count() == 0


@pytest.mark.parametrize("cells", [None, (40, 300, 100)])
def test_topk_search(spark, monkeypatch, cells):
    for name, value in zip(("QUERY_CELLS", "CANDIDATE_CELLS", "SCORES"), cells or (), strict=False):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    odd = [(1000, None), (1050, [float("nan")] * 6), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1150, [float("inf")] * 6), (None, [1.0] * 6), (7, vectors[7][1])]
    frame = spark.createDataFrame([(*v, 1) for v in vectors + odd], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in topk_search.top_k(frame).collect())
    q = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in vectors + odd[5:]]
    expected = []
    for i, v in q:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in q if j != i)[:5]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(expected)
    assert topk_search.top_k(frame.where("false")).count() == 0 and topk_search.top_k(frame.where("vec_id = 0")).count() == 0


def test_packing(docs):
    t = Tokenizer.from_file(WORD)
    pieces = packing.pack(docs.repartition(2), WORD).collect()
    want = Counter(np.array([*t.encode("no id" if i is None else x or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for i, x in [*enumerate(TEXTS), (6, TEXTS[6]), (None, "no id")])
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    by = defaultdict(dict)
    for p in pieces:
        if p.doc_id not in (6,):
            by[p.doc_id][p.start] = p.ids
    for parts in by.values():
        whole = b""
        for start in sorted(parts):
            assert 4 * start == len(whole)
            whole += parts[start]
        assert whole in want
    assert packing.pack(empty(docs), WORD).count() == 0


@pytest.mark.parametrize(("window", "most"), [(32, 10_000), (32, 8), (2048, 10_000)])
def test_packer_follows_the_sum_of_squares_rule(monkeypatch, window, most):
    monkeypatch.setattr(packing, "MOST_OPEN", most)
    rng = np.random.default_rng(6)
    packer = packing.SumOfSquaresPacker(0, window)
    total, above_one, best_fit, choices = 0, 0, 0, 0
    for i in range(1500):
        size = int(min(5 * window // 2, rng.gamma(0.7, window / 2) + 1))
        rest = size % window
        if rest:
            count = packer.count.copy()
            held = [h for h in range(1, window - rest + 1) if count[h]]

            def cost(level, size=rest, count=count):
                after = count.copy()
                after[level] -= level > 0
                after[level + size] += 1
                return int((after[1:window] ** 2).sum())

            chosen = packer.choose(rest)
            costs = {h: cost(h) for h in [0, *held]}
            assert chosen in costs and costs[chosen] == min(costs.values()) and chosen == max(h for h, c in costs.items() if c == costs[chosen])
            if held:
                choices += 1
                best_fit += chosen == max(held)
            above_one += bool((count[1:window] > 1).any())
        packer.add(i, b"\1\0\0\0" * size)
        total += size
        assert packer.n_open < most
    if most > 1500:
        # The level array has levels of several windows to weigh, and the rule isn't best fit.
        assert above_one > 20 and best_fit < 0.9 * choices
    handed = [d for d in packer.done if d[7]]
    left = [p for level in packer.open for w in level for p in w]
    assert sum(d[2] for d in packer.done) + sum(len(p[2]) // 4 for p in left) == total
    filled = Counter()
    for d in packer.done:
        filled[d[5]] += d[2]
    assert {f for s, f in filled.items() if s not in {d[5] for d in handed}} == {window} and (most > 1500) == (not handed)
    packer.pour()
    assert packer.n_open == 0 and not packer.count.any()
    filled = Counter()
    for d in packer.done:
        filled[d[5]] += d[2]
    short = [f for s, f in filled.items() if s not in {d[5] for d in handed} and f < window - window // packing.SLACK]
    assert len(short) <= 1 and sum(filled.values()) == total
    pieces = defaultdict(list)
    for d in packer.done:
        pieces[d[0]].append((d[1], d[2]))
    for parts in pieces.values():
        assert [s for s, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]


@pytest.mark.parametrize(("sizes", "step", "most"), [("mixed", 4096, 4096), ("mixed", 20, 4096), ("equal", 10, 50), ("mixed", 15, 30)])
def test_packing_in_steps(spark, monkeypatch, sizes, step, most):
    monkeypatch.setattr(packing, "STEP_WINDOWS", step)
    monkeypatch.setattr(packing, "MOST_OPEN", most)
    rng = np.random.default_rng(8)
    lengths = [45] * 300 if sizes == "equal" else [int(min(150, rng.gamma(0.7, 32) + 1)) for _ in range(600)]
    docs = spark.createDataFrame([(i, " ".join(["a"] * (n - 1))) for i, n in enumerate(lengths)], "doc_id long, text string").repartition(8)
    pieces = packing.pack(docs, WORD, window=64).collect()
    filled, by = defaultdict(list), defaultdict(list)
    for p in pieces:
        filled[p.sequence_id].append((p.offset, p.length))
        by[p.doc_id].append((p.start, p.length))
        assert p.doc_tokens == lengths[p.doc_id] and len(p.ids) == 4 * p.length
    for parts in [*filled.values(), *by.values()]:
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert sum(p.length for p in pieces) == sum(lengths)
    fills = [sum(n for _, n in parts) for parts in filled.values()]
    assert max(fills) <= 64 and len(fills) <= 1.02 * sum(lengths) / 64 + len(lengths) / step + 1
    if sizes == "mixed" and step == 4096:
        assert len({i for i, parts in by.items() if len(parts) > 1 + lengths[i] // 64}) < 0.05 * len(lengths)  # few are cut


def test_few_windows_are_poured_at_32_partitions(spark, monkeypatch):
    """The token counts of the driver's documents, packed in 32 parts and a second step."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = [r.n for r in docs.selectExpr("doc_id", "greatest(1, cast(length(text) / 2.6 as int)) AS n").orderBy("doc_id").collect()]
    left, closed = [], 0
    for part in range(32):
        packer = packing.SumOfSquaresPacker(0)
        for n in sizes[part::32]:
            packer.add(0, bytes(4 * n))
        packer.hand_over()
        left += [d[2] for d in packer.done if d[7]]
        closed += len({d[5] for d in packer.done if not d[7]})
    packer = packing.SumOfSquaresPacker(0)
    for n in sorted(left, reverse=True):
        packer.place((0, 0, bytes(4 * n), n))
    packer.pour()
    total = closed + packer.next_id
    print("windows", total, "poured", packer.poured)
    assert packer.poured < 0.05 * total and total < 1.005 * sum(sizes) / 2048 + 1
