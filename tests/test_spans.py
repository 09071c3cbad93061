"""Span matching and strict measures against plain Python."""

import random

from threatloom.operators import spans as S

FORM = str.maketrans("‘’“”", "''\"\"")


def relaxed(t):
    return " ".join((t or "").translate(FORM).split())


def plain_greedy(gold, pred, threshold):
    taken, out = set(), []
    for g, a in gold:
        best = None
        for p, b in pred:
            x, y = set(relaxed(a).split(" ")), set(relaxed(b).split(" "))
            o = len(x & y) / len(x | y)
            if p not in taken and o >= threshold and (best is None or o > best[0]):
                best = (o, p, len(relaxed(b)) - len(relaxed(a)))
        if best:
            taken.add(best[1])
            out.append((g, best[1], best[2]))
    return out


def made(rng, n):
    return [(i, " ".join(rng.choice("a b c d e “f” \"f\" \t g".split(" ")) for _ in range(rng.randrange(0, 6)))) for i in range(n)]


def frames(spark, cases):
    schema = "article_id long, idx int, text string"
    return tuple(spark.createDataFrame([(k, i, t) for k, case in cases.items() for i, t in case[side]], schema) for side in (0, 1))


def test_greedy_match_equals_plain_python(spark):
    rng = random.Random(2)
    cases = {k: (made(rng, rng.randrange(0, 9)), made(rng, rng.randrange(0, 9))) for k in range(60)}
    cases[99] = ([(0, None), (1, ""), (2, "x y")], [(0, "  "), (1, "x y z")])
    # A chain: every span but the last has to wait for the one before it.
    cases[100] = ([(i, f"k{i} k{i + 1}") for i in range(8)], [(i, f"k{i} k{i + 1} z") for i in range(8)])
    gold, pred = frames(spark, cases)
    for threshold in (0.5, 0.8, 1.0):
        found = S.greedy(S.token_pairs(gold, pred, threshold=threshold)).collect()
        got = {k: sorted((r.gold, r.pred, r.delta) for r in found if r.article_id == k) for k in cases}
        assert got == {k: sorted(plain_greedy(g, p, threshold)) for k, (g, p) in cases.items()}
    rows = {r.article_id: r for r in S.span_metrics(gold, pred).collect()}
    for k, (g, p) in cases.items():
        m = plain_greedy(g, p, 0.5)
        if g or p:
            assert (rows[k].tp, rows[k].fp, rows[k].fn) == (len(m), len(p) - len(m), len(g) - len(m))
    t = S.totals(S.span_metrics(gold, pred)).first()
    assert t.articles == sum(bool(g or p) for g, p in cases.values()) and t.fp_rate_per_document == round(sum(r.fp > 0 for r in rows.values()) / t.articles + 1e-9, 4)
    assert S.totals(S.span_metrics(gold.where("false"), pred.where("false"))).first().f1 == 0.0


def test_waiting_spans_choose_again(spark):
    # All golds like pred 0 best; each that loses it takes the next best.
    gold = [(i, "a b c") for i in range(4)]
    pred = [(0, "a b c"), (1, "a b c d"), (2, "a b"), (3, "q")]
    g, p = frames(spark, {1: (gold, pred)})
    assert sorted((r.gold, r.pred) for r in S.greedy(S.token_pairs(g, p, threshold=0.5)).collect()) == [(0, 0), (1, 1), (2, 2)]


def plain_gold(gold, pred):
    strict = lambda t: (t or "").translate(FORM).strip()
    taken, exact, merged = set(), 0, 0
    for _, a in gold:
        hit = next((i for i, b in pred if i not in taken and strict(a) == strict(b)), None)
        if hit is not None:
            taken.add(hit)
            exact += 1
        elif any(i not in taken and len(strict(b)) > 1.5 * len(strict(a)) for i, b in pred):
            merged += 1
    truncated = sum(any(len(strict(b)) < 0.7 * len(strict(a)) for _, b in pred) for _, a in gold)
    words = lambda t: set(strict(t).split())
    odd = sum(len(words(b)) > 3 and not any(words(b) <= words(a) or words(a) <= words(b) for _, a in gold) for _, b in pred) if gold else 0
    return len(gold), len(pred), exact, len(pred) - exact, merged, truncated, odd, len(pred) == exact


def test_gold_metrics_equal_plain_python(spark):
    rng = random.Random(3)
    cases = {k: (made(rng, rng.randrange(0, 7)), made(rng, rng.randrange(0, 7))) for k in range(80)}
    cases[99] = ([(0, " cmd /c “x”\n"), (1, "same"), (2, "same")], [(0, 'cmd /c "x"'), (1, "same"), (2, "other words that are long"), (3, "s")])
    gold, pred = frames(spark, cases)
    rows = S.gold_metrics(gold, pred)
    got = {r.article_id: tuple(r)[1:] for r in rows.collect()}
    assert got == {k: plain_gold(g, p) for k, (g, p) in cases.items() if g or p}
    t = S.gold_totals(rows).first()
    assert t.sample_count == sum(len(g) for g, _ in cases.values()) and t.most_merged == max(v[4] for v in got.values()) and t.without_gold == sum(not g and bool(p) for g, p in cases.values())
    failures = {(r.article_id, r.failure_type): r.n for r in S.failure_rows(rows).collect()}
    assert {k: n for (k, f), n in failures.items() if f == "hallucination_on_empty"} == {k: v[3] for k, v in got.items() if not v[0] and v[3]}
    assert {k: n for (k, f), n in failures.items() if f == "merged_commands"} == {k: v[4] for k, v in got.items() if v[4]}


def test_spans_are_shuffled_once(spark, capsys):
    gold, pred = frames(spark, {1: ([(0, "a b")], [(0, "a b")])})
    gold, pred = gold.where("idx >= 0"), pred.where("idx >= 0")
    S.token_pairs(gold, pred, threshold=0.5).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    began = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    S.span_metrics(gold, pred)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == began  # no rounds that write tables
    S.gold_metrics(gold, pred).explain()
    assert capsys.readouterr().out.count("Exchange") <= 12
