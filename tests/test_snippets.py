"""Attention snippets and command candidates against plain Python."""

import random
import re

from threatloom.operators import snippets as S

I = re.IGNORECASE
VERBS = set(S.NARRATIVE)


def command_line(line):
    def anchored(x):
        return any(w.lower() in x.lower() for w in S.COMMAND_WORDS) or any(re.search(p, x, I) for p in S.COMMAND_PATTERNS)

    def shaped(x):
        if m := re.search(S.EXE_AND_ARGUMENT, x, I):
            word = x[m.end() - 1 :].split()[0]
            if re.sub("[,.;:]$", "", word).lower() not in VERBS:
                return True
        m = re.search(S.EXE_AND_WORD, x, I)
        return bool(re.search(S.QUOTED_EXE, x, I) or (m and m[1].lower() not in VERBS) or len(re.findall(S.WINDOWS_PATH, x, I)) >= 2)

    told = any(anchored(x) or shaped(x) for x in (line, line.replace("^", "")) if x.strip())
    if told and ".exe" in line.lower() and not any(c in line for c in S.ARGUMENT_MARKS) and any(m[1].lower() in VERBS for m in re.finditer(r"\.exe\s+(\w+)", line, I)):
        names = {m[1].lower() for m in re.finditer(r"(\w+)\.exe\b", line, I)}
        if not any(re.search(p, line, I) for p in S.COMMAND_PATTERNS) and not any(w.lower() in line.lower() and w.lower() not in names for w in S.COMMAND_WORDS):
            return False
    return told


def plain(text, rules, tells, reach=lambda line: 1, sentences=False):
    out, every = [], (text or "").splitlines()
    for i, line in enumerate(every):
        if not line.strip() or not tells(line):
            continue
        n = reach(line)
        before, after = every[max(0, i - n) : i], every[i + 1 : i + 1 + n]
        if len(line) <= 500:
            found = ["\n".join([*before, line, *after]).strip()]
        else:
            cover = [False] * (len(line) + 1)
            pieces, spans = [], sorted((max(0, a - rules.window), min(len(line), b + rules.window)) for a, b in rules.places(line))
            for a, b in spans:  # characters, and the gaps that windows may leave open
                for k in range(a, min(len(line), b + rules.meet) + 1):
                    cover[k] = True
            ends = sorted({b for _, b in spans})
            k = 0
            while k <= len(line):
                if cover[k]:
                    j = k
                    while j < len(line) and cover[j + 1]:
                        j += 1
                    a, b = k, max(e for e in ends if e <= j)
                    lo, hi = max(0, a - rules.window), min(len(line), b + rules.window)
                    if sentences:
                        lo = max([lo, *(lo + m.end() for m in re.finditer(S.SENTENCE_END, line[lo:a]))])
                        hi = min([hi, *(b + m.end() for m in re.finditer(S.SENTENCE_END, line[b:hi]))])
                    if line[lo:hi].strip():
                        pieces.append(line[lo:hi].strip())
                    k = j
                k += 1
            found = pieces
            if found and any([*before, *after]):
                found[0] = "\n".join(p for p in [*before, found[0], *after] if p).strip()
            if not found and rules.whole_if_none:
                found = ["\n".join([*before, line, *after]).strip()]
        out += [s for s in found if s]
    return list(dict.fromkeys(out))


PIECES = [
    "plain words here", "", "  ", "The tool.exe process reached out", "MSBuild.exe process ran powershell too", "cmd.exe /c whoami", "p^ow^er^sh^ell -enc AAA", "net user x", "network share", "internet", "sc query y", "scan query",
    "C:\\a\\b.exe C:\\c\\d.txt", '"C:\\x y\\t.exe" Run', "tool.exe verb", "tool.exe (Grixba)", "tool.exe using it", "at 12:30 we met", "hh.exe x", "evil.exe -k", "attachment.iso", "winword.exe spawned cmd.exe", "explorer -> cmd", "the child of services.exe",
    "it called him", "it called him.exe", "Parent: 12", "├─ a.exe", "│ └─ b.exe", "ParentImage: x Image: y", "PID: 1234, PPID: 5678", "running under svc", "a.exe and then b.exe were spawned", "\x0b", "x\x85y",
]


def texts(rng, n):
    out = [None, "", "\n\n", "powershell", "a\npowershell\n"]
    for _ in range(n):
        out.append("\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 8))) + rng.choice(["", "\n", "\r\n"]))
    for _ in range(n // 3):
        filler = lambda: " ".join(rng.choice(["lorem", "ipsum.", "dolor", "sit."]) for _ in range(rng.randrange(20, 260)))
        out.append("head\n" + filler() + "".join(f" {rng.choice(PIECES[3:])} {filler()}" for _ in range(rng.randrange(0, 4))) + "\n" + rng.choice(PIECES))
    return out


def compared(spark, rules, tells, reach, seed):
    every = texts(random.Random(seed), 150)
    frame = spark.createDataFrame(list(enumerate(every)), "article_id long, content string")
    for sentences in (False, True):
        got = {}
        for r in sorted(S.attention_snippets(frame, rules, sentences=sentences).collect(), key=lambda r: (r.article_id, r.position)):
            got.setdefault(r.article_id, []).append(r.snippet)
        assert got == {i: w for i, t in enumerate(every) if (w := plain(t, rules, tells, reach, sentences))}
    first = S.attention_snippets(frame, rules, most=1).collect()
    assert {r.position for r in first} == {1} and len(first) == len(got)
    assert S.attention_snippets(frame.where("false"), rules).count() == 0


def test_command_snippets_equal_plain_python(spark):
    compared(spark, S.command_rules(), command_line, lambda line: 1, 1)


def tree_line(line):
    has = lambda p: re.search(p, line, I)
    shapes = [m.span() for m in re.finditer(S.EXE_SHAPE, line, I)]
    strong = (
        any(w.lower() in line.lower() for w in S.TREE_WORDS) or any(has(p) for p in S.TREE_STRONG)
        or any(re.search(S.LINEAGE, line[max(0, a - 60) : d + 60], I) for i, (a, _) in enumerate(shapes) for _, d in shapes[i + 1 :])
        or (has(S.PATH_MARK) and has(S.LINEAGE)) or (has(r"\bParentImage\b") and has(r"\bImage\b")) or (has(r"\bParentCommandLine\b") and has(r"\bCommandLine\b")) or len(re.findall(S.PROCESS_NUMBER, line, I)) >= 2
    )
    return bool(strong or (any(has(p) for p in S.TREE_WEAK) and (shapes or has(S.PATH_MARK) or any(g in line for g in S.TREE_GLYPHS))))


def test_tree_snippets_equal_plain_python(spark):
    reach = lambda line: 2 if line.lstrip().startswith(S.TREE_PREFIXES) or re.search(S.TREE_GLYPH_LINE, line, I) else 1
    compared(spark, S.tree_rules(), tree_line, reach, 2)


def test_candidates_equal_plain_python(spark):
    rng = random.Random(5)
    pieces = [r"C:\Windows\System32\net.exe user", "net.exe user", "powershell -enc x", "powershell.exe -enc x", r'"C:\a b\c.exe" -k', "tool.exe -a -b", "tool.exe -a", "no command", r"C:\tools\tool.exe -a -b", "tool.exe"]
    every = [None, "", "x"] + ["\n".join(" ".join(rng.choices(pieces, k=rng.randrange(1, 3))) for _ in range(rng.randrange(1, 9))) for _ in range(1000)]

    def expected(text):
        kept = []
        for p in S.CANDIDATES:
            for m in re.finditer(p, text or "", I | re.MULTILINE):
                c = m.group(0).strip()
                for i, e in enumerate(kept):
                    if c in e:
                        break
                    if e in c:
                        kept[i] = c
                        break
                else:
                    kept.append(c)
        return kept

    frame = spark.createDataFrame(list(enumerate(every)), "article_id long, content string").repartition(3)
    got = {}
    for r in sorted(S.command_candidates(frame).collect(), key=lambda r: (r.article_id, r.position)):
        got.setdefault(r.article_id, []).append(r.candidate)
    assert got == {i: w for i, t in enumerate(every) if (w := expected(t))}
    where = {(r.article_id, r.position): r for r in S.candidate_lines(S.command_candidates(frame), frame, context=2).collect()}
    for (i, _), r in where.items():
        all_lines = every[i].splitlines()
        no = next(k for k, line in enumerate(all_lines) if r.candidate.splitlines()[0] in line)
        assert (r.no, r.line, r.before, r.after) == (no, all_lines[no], all_lines[max(0, no - 2) : no], all_lines[no + 1 : no + 3])
