"""Keywords of a passed registry: word edges, endings, prefixes, symbols and patterns."""

import html
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threatloom.functions import text as T
from threatloom.operators import chunks, reports
from threatloom.operators import keywords as K

CASES = [
    ("cmd", "a Command here", False), ("cmd", "run CMD /c", True), ("cmd.exe", "cmd /c dir", True), ("cmd.exe", "cmd.exe", True), ("cmd.exe", "cmdlet", False),
    (".lnk", "a .lnk file", False), (".lnk", "open report.LNK now", True), (".lnk", "report.lnks", False),
    ("svchost.exe", "svchost alone", False), ("svchost.exe", "xsvchost.exe", False), ("svchost.exe", r"C:\svchost.exe -k", True),
    ("comsvcs.dll", "comsvcs, MiniDump", True), ("comsvcs.dll", "comsvcs.dll", True), ("comsvcs.dll", "comsvcsx", False),
    ("spawn", "it spawned two", True), ("spawn", "respawned", True), ("hunting", "threathunting", True),
    ("-enc", "powershell -enc abc", True), ("-enc", "powershell -encoded", False), ("-enc", "x-enc", False), ("-enc", "1-enc2", True),
    ("token =", "token = 'x'", False), ("token =", "token =x", True), ("mit license", "the MIT License.", True), ("mit license", "the MIT  License", False),
    ("==", "a==b", True), ("|", "a|b", True), ("C:\\", "C:\\temp", True), ("apache", "apaches", False), ("idiot", "éidiot", False), (T.OBFUSCATION[6], "%a%%b%%c%%d%", True),
    (T.OBFUSCATION[4], "SET x = 1", True), (T.OBFUSCATION[14], " c^m^d ", True), (T.OBFUSCATION[14], " cmd ", False),
]


def test_keyword_rules(spark):
    frame = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, t string")
    words = list(dict.fromkeys(w for w, _, _ in CASES))
    found = {r.i: set(r.m) for r in frame.select("i", T.matches(F.col("t"), words).alias("m")).collect()}
    assert [(w, t) for i, (w, t, hit) in enumerate(CASES) if (w in found[i]) != hit] == []


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_passed_registry_is_scored_by_the_rules(spark, n):
    words = ["cmd", "svchost.exe", ".lnk"]
    text = " ".join(["commands svchost .lnk", "cmd", "svchost.exe", "a.lnk"][: n + 1])
    registry = {"perfect": words}
    frame = spark.createDataFrame([(1, text)], "article_id int, content string")
    assert frame.select(T.hunt_score(F.col("content"), registry)).first()[0] == pytest.approx(75 * (1 - 0.5**n), abs=0.051)
    assert {r.keyword for r in reports.keyword_stats(frame, registry).collect()} == set(words[:n])
    assert frame.select(*chunks.features(F.col("content"), registry)).first().perfect_matches == n


def plain_resolution(text, registry):
    """Clusters, winners and merged neighbours, by comparing all spans with each other."""
    rank = list(K.CATEGORIES)
    spans = [(m.start(), m.end(), w, c) for c, ws in registry.items() for w in ws for m in re.finditer(K.span_pattern(w), text, re.IGNORECASE)]
    cluster = {s: s for s in spans}
    for _ in spans:  # spans that overlap are in one cluster
        for a in spans:
            for b in spans:
                if a[0] < b[1] and b[0] < a[1]:
                    cluster[a] = cluster[b] = min(cluster[a], cluster[b])
    won = []
    for s in sorted(spans, key=lambda s: (s[3] != "perfect", 0 if s[3] == "perfect" else s[0] - s[1], rank.index(s[3]), s[0], s[2].lower())):
        if not any(s[0] < w[1] and w[0] < s[1] for w in won):
            won.append(s)
    out = []
    for s in sorted(won):
        near = Counter(o[3] for o in spans if cluster[o] == cluster[s] and o[0] < s[1] and s[0] < o[1])
        if out and out[-1][1] == s[0] and out[-1][2] == s[3]:
            out[-1] = (out[-1][0], s[1], s[3], out[-1][3] + near)
        else:
            out.append((s[0], s[1], s[3], near))
    return [(a, z, c, tuple(sorted(n, key=rank.index)), tuple(sorted(n.items()))) for a, z, c, n in out]


def test_resolved_spans_equal_plain_python(spark):
    rng = random.Random(4)
    registry = {"perfect": ["-a", "b.exe"], "good": ["a b", "$", "spawn"], "lolbas": ["b a", "cmd.exe", "hunting"], "intelligence": ["a b a", ".lnk"], "negative": ["a", "Ä"]}
    pieces = ["a", "b", " ", " ", "a b", "$", "-a", "b.exe", "cmd", "cmd.exe", "spawned", "x.lnk", "hunting", "ä", "\n", "_", "7", "c"]
    texts = ["", None, "$$$", "a b a b a b a", "cmd1 cmd_ cmd.exe8"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "article_id long, content string")
    got = {}
    for r in K.resolved(frame, registry).collect():
        got.setdefault(r.article_id, []).append((r.start, r.end, r.category, tuple(r.sources), tuple((c.category, c.n) for c in r.counts)))
    assert {i: sorted(x) for i, x in got.items()} == {i: w for i, t in enumerate(texts) if t and (w := plain_resolution(t, registry))}
    shown = {r.article_id: r.html for r in K.highlighted(frame, K.resolved(frame, registry), classes={"good": "mark"}).collect()}
    assert all(html.unescape(re.sub(r"</?span[^>]*>", "", shown[i])) == (t or "") for i, t in enumerate(texts))
    assert 'keyword-highlight--good mark" data-keyword-category="good" data-source-categories="good" title="Category: Good">$$$</span>' in shown[2]
    assert K.resolved(frame.where("false"), registry).count() == K.resolved(frame, {}).count() == 0


def test_spans_and_texts_are_not_shuffled(spark, capsys):
    registry = {"perfect": ["a b"], "good": ["b a", "|"], "negative": ["a"]}
    texts = [None, "", "|||", "a b a | a", "no", "b a||b a"]
    frame = spark.createDataFrame(list(enumerate(texts)), "article_id long, content string")
    spans = K.resolved(frame, registry)
    assert sorted(K.highlights(frame, registry).collect()) == sorted(K.highlighted(frame, spans).collect())
    assert sorted(K.panel(frame, registry).collect()) == sorted(K.panel_items(frame, spans).collect())
    for rows, exchanges in ((spans, 0), (K.highlights(frame, registry), 0), (K.panel(frame, registry), 1)):
        capsys.readouterr()
        rows.explain()
        out = capsys.readouterr().out
        assert out.count("Exchange") == exchanges and "Window" not in out


def test_titles(spark):
    row = spark.range(1).select(
        K.title(F.lit("good"), F.array(F.lit("good"))).alias("a"), K.title(F.lit("good"), F.array(F.lit("good"), F.lit("lolbas"))).alias("b"), K.title(F.lit("lolbas"), F.array(F.lit("good"), F.lit("lolbas"))).alias("c"),
    ).first()
    assert tuple(row) == ("Category: Good", "Category: Good | Highest-priority match among: Good, LOLBAS", "Category: LOLBAS | More-specific match among: Good, LOLBAS")


def test_registry_file(spark, tmp_path):
    path = tmp_path / "words.yaml"
    path.write_text("keywords:\n- match: cmd.exe\n  tier: perfect\n- match: 'C:\\'\n  tier: good\n  platforms: [windows]\n  weight: 3\n- match: dpkg\n  platforms: [linux, macos]\n- match: Zed\n  tier: perfect\n")
    registry = K.read_registry(spark, str(path))
    assert K.words_by_tier(registry) == {"perfect": ["cmd.exe", "Zed"], "good": ["C:\\"], "lolbas": [], "intelligence": [], "negative": []}
    assert K.platform_weights(registry) == {"windows": {"c:\\": 3}, "linux": {"dpkg": 1}, "macos": {"dpkg": 1}}
    frame = spark.createDataFrame([(1, r"run CMD /c in C:\temp")], "article_id int, content string")
    assert frame.select(T.hunt_score(F.col("content"), K.words_by_tier(registry))).first()[0] == 40.0
    path.write_text("keywords: 3\n")
    with pytest.raises(Exception, match="no list of keywords"):
        K.read_registry(spark, str(path)).collect()
    path.write_text("keywords:\n- match: a\n  tier: best\n")
    with pytest.raises(ValueError, match="unknown tiers"):
        K.words_by_tier(K.read_registry(spark, str(path)))
