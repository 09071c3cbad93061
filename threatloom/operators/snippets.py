"""Attention snippets: the lines of a text that look like command lines or process trees, with what stands around them.

Lines are told by native expressions; only long lines that are told go to Python, where the places of the matches become windows and
windows that meet become one. Snippets are unique in each text and stay in the order in which they first come.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.session import map_rows

#: Where Python's splitlines cuts.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# A line of more characters than this is long.
LONG_LINE = 500
SENTENCE_END = r"(?<=\.)(?!\w)\s+"

# Command-line anchors, as plain text and as patterns.
COMMAND_WORDS = (
    "powershell", "pwsh", "rundll32", "regsvr32", "msiexec", "wmic", "certutil", "bitsadmin", "schtasks", "netsh", "mshta", "cscript", "wscript", "forfiles", "findstr", "taskkill", "systeminfo", "diskshadow",
    "makecab", "esentutl", "msbuild", "msdt", "installutil", "regasm", "regsvcs", "regini", "odbcconf", "cmstp", "mavinject", "xwizard", "presentationhost", "curl", "wget",
    "%WINDIR%", "%TEMP%", "%TMP%", "\\temp\\", "\\pipe\\", "syswow64", "wbem", "comspec",
    "FromBase64String", "DownloadString", "DownloadFile", "DownloadData", "WebClient", "Invoke-WebRequest", "Invoke-Expression", "IEX", "New-Object", "MemoryStream", "Add-MpPreference", "Set-MpPreference",
    ".lnk", ".iso", ".vhd", ".vhdx",
    "comsvcs", "lsass", "mimikatz", "sekurlsa", "procdump",
    "whoami", "vssadmin", "wevtutil", "nltest", "bcdedit", "adfind", "psexec", "nslookup",
    "-NoProfile", "-WindowStyle", "-ExecutionPolicy", "-NonInteractive",
)
COMMAND_PATTERNS = (
    r"\bcmd(\.exe)?\b",
    r"\breg(\.exe)?\s+(add|delete|query|save|load)\b",
    r"-(encodedcommand|enc)\b",
    r"\brundll32(\.exe)?\s+[^,\s]+,\S+",
    r"\.(lnk|iso|vhd|vhdx)\b",
    r"\bsc(\.exe)?\s+(start|stop|create|delete|config|query|description)\b",
    r"\bexpand(\.exe)?\s+[A-Za-z]:\\",
    r"\bnet(\.exe)?\s+(user|group|use|share|view|localgroup|accounts|session|start|stop|computer)\b",
    r"\btftp(\.exe)?\b",
    r"\bhh(\.exe)?\s+\S",
    r"\bwsl(\.exe)?\b",
    r"\bbash(\.exe)?\s+(-c|-i)\b",
    r"\bat(\.exe)?\s+\d{1,2}:\d{2}\b",
)
EXE_AND_ARGUMENT = r"(?:[^\s\"]+\.exe|\"[^\"]*\.exe\")\s+[^(\s\[\{]"
QUOTED_EXE = r"\"[^\"]*\.exe\"\s+[A-Za-z0-9]"
EXE_AND_WORD = r"\.exe\b\s+([A-Za-z]\w*)"
WINDOWS_PATH = r"[A-Za-z]:\\[^\s]*"
ARGUMENT_MARKS = '-/"><|'
NARRATIVE = (
    "process", "application", "file", "version", "manager", "handler", "service", "component", "child", "parent", "reached", "observed", "started", "stopped", "created", "dropped",
    "ran", "executed", "invoked", "spawned", "launched", "terminated", "installed", "deployed", "triggered",
    "using", "via", "hosting", "calling", "leveraging", "with", "within", "based", "found", "located", "attempting", "trying", "able", "known", "running",
)
# The same of process trees; patterns that are strong by themselves stand apart.
TREE_WORDS = (
    "Process Create", "ProcessCreate", "ProcessCreated", "EventID 1", "Event ID 1", "ParentImage", "ParentCommandLine", "ParentProcessName", "ParentProcessId", "ParentProcessGuid",
    "→", "->", "-->", "└─", "├─", "└──", "├──", "└>",
)
TREE_WEAK = (
    r"\b[\w\-.]+(?:\.exe)?\s+(?:spawn(?:s|ed|ing)?|launch(?:es|ed|ing)?|execut(?:e|es|ed|ing)|invok(?:e|es|ed|ing)|start(?:s|ed|ing)?|creat(?:e|es|ed|ing)|r(?:an|uns|unning)|call(?:s|ed|ing)?|load(?:s|ed|ing)?)\s+[\w\-.]+(?:\.exe)?\b",
    r"\b[\w\-.]+(?:\.exe)?\s+(?:was\s+)?(?:spawned|launched|executed|created|invoked|started|loaded)\s+by\s+[\w\-.]+(?:\.exe)?\b",
    r"\bchild\s+of\s+[\w\-.]+(?:\.exe)?",
    r"\brunning\s+under\s+[\w\-.]+(?:\.exe)?",
    r"\b(?:in|with)\s+the\s+context\s+of\s+[\w\-.]+(?:\.exe)?",
)
TREE_GLYPH_LINE = "^\\s*(?:[│|]\\s*)*(?:[└├]─{1,3}|\\\\->|\\|-)\\s*\\S*\\.exe"
TREE_STRONG = (
    r"\b(?:parent|child)\s+(?:process|pid|image|id|command\s*line)\b",
    r"\b(?:parent|child)\s*[:=]\s*\S",
    "[\\w\\-.]+\\.exe\\s*(?:-+>|→|=+>)\\s*[\\w\\-.]+\\.exe",
    TREE_GLYPH_LINE,
)
EXE_SHAPE = r"\b[a-zA-Z0-9_\-]+\.(?:exe|dll|scr|com|bat|cmd|ps1)\b"
PATH_MARK = r"[A-Za-z]:\\|\\\\[\w\-]+|\"[^\"]*\.(?:exe|dll|scr|com|bat|cmd|ps1)\"|(?<![A-Za-z0-9])\\[A-Za-z0-9_\-]{2,}\.(?:exe|dll|scr|com|bat|cmd|ps1)"
LINEAGE = r"\b(?:parent|child|spawn(?:s|ed|ing)?|inject(?:s|ed|ing)?|launch(?:es|ed|ing)?|execut(?:e|es|ed|ing)|creat(?:e|es|ed|ing)|lineage|tree|ancestor|descendant)\b"
#: One of these stands in what the patterns match: shapes of executables, lineage, weak patterns.
EXTENSIONS = (".exe", ".dll", ".scr", ".com", ".bat", ".cmd", ".ps1")
LINEAGE_WORDS = ("parent", "child", "spawn", "inject", "launch", "execut", "creat", "lineage", "tree", "ancestor", "descendant")
WEAK_WORDS = ("spawn", "launch", "execut", "invok", "start", "creat", "ran", "run", "call", "load", "child", "context")
TREE_GLYPHS = ("→", "->", "-->", "==>", "└─", "├─", "└──", "├──", "└>", "\\->", "|-")
TREE_PREFIXES = ("└", "├", "\\->", "|-", "│")
PROCESS_NUMBER = r"\b(?:p?pid|process\s*id|parent\s*pid)\s*[:=]?\s*\d{2,}"

Places = list[tuple[int, int]]


@dataclass(frozen=True)
class Rules:
    """What tells a line, how many lines around it belong to it, and the windows of long lines."""

    tells: Callable[[Column], Column]
    places: Callable[[str], Places]
    window: int
    meet: int = 0  # windows this far apart still meet
    reach: Callable[[Column], Column] = field(default=lambda line: F.lit(1))  # lines before and after, 2 at most
    whole_if_none: bool = False  # a long line without places of its own is taken whole


def like(line: Column, *patterns: str) -> Column:
    return F.rlike(line, F.lit("(?iuU)" + "|".join(patterns)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds(line: Column, words: tuple[str, ...]) -> Column:
    return once(F.lower(line), words)


def once(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text holds one of the words; as an element of an array it is computed once for all of them."""
    return F.exists(F.array(text), lambda x: any_of([F.contains(x, F.lit(w.lower())) for w in words]))


def mentions(line: Column, *words: str) -> Column:
    """Whether a line holds one of the words in any case that a pattern heeds: a cheap condition that stands before a costly pattern."""
    folded = F.lower(F.translate(line, "\u017f\u212a\u0131\u0130", "skii"))
    return once(folded, words)


def found(pattern: str, line: str) -> Iterator[re.Match]:
    return re.finditer(pattern, line, re.IGNORECASE)


def word_places(words: tuple[str, ...], line: str) -> Places:
    """Every place of every word, overlapping ones too."""
    lowered, out = line.lower(), []
    for word in words:
        at = lowered.find(word.lower())
        while at >= 0:
            out.append((at, at + len(word)))
            at = lowered.find(word.lower(), at + 1)
    return out


def command_rules(words: tuple[str, ...] = COMMAND_WORDS, patterns: tuple[str, ...] = COMMAND_PATTERNS) -> Rules:
    """Lines with an anchor or the shape of an executable and its arguments, carets aside; not those that only tell a story about one."""
    narrative = F.array(*map(F.lit, NARRATIVE))

    def shape(line: Column) -> Column:
        # The word behind the executable, without one closing mark.
        word = F.regexp_replace(F.regexp_extract(line, "(?iuU)(?:[^\\s\"]+\\.exe|\"[^\"]*\\.exe\")\\s+([^(\\s\\[\\{]\\S*)", 1), r"[,.;:]$", "")
        verb = F.regexp_extract(line, "(?iuU)" + EXE_AND_WORD, 1)
        executable = (like(line, EXE_AND_ARGUMENT) & ~F.array_contains(narrative, F.lower(word))) | like(line, QUOTED_EXE) | ((verb != "") & ~F.array_contains(narrative, F.lower(verb)))
        return (mentions(line, ".exe") & executable) | (F.contains(line, F.lit(":\\")) & (F.regexp_count(line, F.lit("(?iU)" + WINDOWS_PATH)) >= 2))

    def story(line: Column) -> Column:
        lowered = F.lower(line)
        verbs = F.transform(F.regexp_extract_all(line, F.lit(r"(?iuU)\.exe\s+(\w+)"), F.lit(1)), F.lower)
        names = F.transform(F.regexp_extract_all(line, F.lit(r"(?iuU)(\w+)\.exe\b"), F.lit(1)), F.lower)
        others = any_of([F.contains(lowered, F.lit(w.lower())) & ~F.array_contains(names, w.lower()) for w in words])
        return F.contains(lowered, F.lit(".exe")) & ~F.rlike(line, F.lit(f"[{re.escape(ARGUMENT_MARKS)}]")) & F.arrays_overlap(verbs, narrative) & ~like(line, *patterns) & ~others

    def tells(line: Column) -> Column:
        plain = F.replace(line, F.lit("^"), F.lit(""))
        anchored = lambda x: holds(x, words) | like(x, *patterns) | shape(x)
        return (anchored(line) | (F.contains(line, F.lit("^")) & anchored(plain))) & ~story(line)

    def places(line: str) -> Places:
        out = [m.span() for p in patterns for m in found(p, line)]
        for m in found(EXE_AND_ARGUMENT, line):
            word = line[m.end() - 1 :].lstrip().split()
            word = word[0] if word else ""
            if (word[:-1] if word.endswith((",", ".", ";", ":")) else word).lower() not in NARRATIVE:
                out.append(m.span())
        out += [m.span() for m in found(QUOTED_EXE, line)]
        out += [m.span() for m in found(EXE_AND_WORD, line) if m[1].lower() not in NARRATIVE]
        paths = [m.span() for m in found(WINDOWS_PATH, line)]
        return out + (paths if len(paths) >= 2 else []) + word_places(words, line)

    return Rules(tells, places, window=350, whole_if_none=True)


def tree_rules(words: tuple[str, ...] = TREE_WORDS) -> Rules:
    """Lines that tell which process started which: labels, arrows, trees, or verbs beside an executable, a path or a glyph."""

    def strong(line: Column) -> Column:
        near = F.regexp_extract(line, f"(?isuU)(.{{0,60}}{EXE_SHAPE}.*{EXE_SHAPE}.{{0,60}})", 1)  # from 60 characters before the first executable to 60 behind the last
        lineage = mentions(line, *LINEAGE_WORDS) & like(line, LINEAGE)
        two_shapes = mentions(line, *EXTENSIONS) & (F.regexp_count(line, F.lit(r"(?iu)[a-z0-9_\-]\.(?:exe|dll|scr|com|bat|cmd|ps1)")) >= 2)
        return (
            holds(line, words)
            | (mentions(line, "parent", "child", ".exe") & like(line, *TREE_STRONG))
            | (lineage & ((path(line) & like(line, PATH_MARK)) | (two_shapes & like(near, LINEAGE))))
            | (mentions(line, "parentimage") & like(line, r"\bParentImage\b") & like(line, r"\bImage\b"))
            | (mentions(line, "parentcommandline") & like(line, r"\bParentCommandLine\b") & like(line, r"\bCommandLine\b"))
            | (mentions(line, "pid", "process") & (F.regexp_count(line, F.lit("(?iuU)" + PROCESS_NUMBER)) >= 2))
        )

    def path(line: Column) -> Column:
        return F.contains(line, F.lit("\\")) | (F.contains(line, F.lit('"')) & mentions(line, *EXTENSIONS))

    def tells(line: Column) -> Column:
        glyph = any_of([F.contains(line, F.lit(g)) for g in TREE_GLYPHS])
        named = glyph | (mentions(line, *EXTENSIONS) & like(line, EXE_SHAPE)) | (path(line) & like(line, PATH_MARK))
        return strong(line) | (mentions(line, *WEAK_WORDS) & named & like(line, *TREE_WEAK))

    def reach(line: Column) -> Column:
        begins = any_of([F.startswith(F.regexp_replace(line, r"(?U)^\s+", ""), F.lit(p)) for p in TREE_PREFIXES])
        return F.when(begins | like(line, TREE_GLYPH_LINE), 2).otherwise(1)

    def places(line: str) -> Places:
        out = word_places(words, line) + [m.span() for p in (*TREE_WEAK, *TREE_STRONG) for m in found(p, line)]
        shapes = [m.span() for m in found(EXE_SHAPE, line)]
        for i, (a, b) in enumerate(shapes):
            for c, d in shapes[i + 1 :]:
                if re.search(LINEAGE, line[max(0, a - 60) : d + 60], re.IGNORECASE):
                    out += [(a, b), (c, d)]
        search = lambda p: re.search(p, line, re.IGNORECASE)
        if (search(PATH_MARK) and search(LINEAGE)) or (search(r"\bParentImage\b") and search(r"\bImage\b")) or (search(r"\bParentCommandLine\b") and search(r"\bCommandLine\b")):
            out.append((0, len(line)))
        numbers = [m.span() for m in found(PROCESS_NUMBER, line)]
        return out + (numbers if len(numbers) >= 2 else [])

    return Rules(tells, places, window=400, meet=1, reach=reach)


def lines(articles: DataFrame) -> DataFrame:
    """article_id, no, line, and the lines before and after it (two at most); nothing is shuffled."""
    cut = F.split(F.coalesce(F.col("content"), F.lit("")), LINE_ENDS, -1)
    every = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    near = lambda x, i: F.struct(i.alias("no"), x.alias("line"), F.slice("__lines", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))).alias("before"), F.slice("__lines", i + 2, F.lit(2)).alias("after"))
    return articles.select("article_id", every.alias("__lines")).select("article_id", F.inline(F.transform("__lines", near)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def windows(line: str, places: Places, width: int, meet: int, sentences: bool) -> list[str]:
    """The pieces of a long line around its places: windows that meet are one, and reach as far again, or to the next sentence."""
    islands: list[list[int]] = []
    for a, b in sorted((max(0, a - width), min(len(line), b + width)) for a, b in places):
        if islands and a <= islands[-1][1] + meet:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    out = []
    for a, b in islands:
        begin, end = max(0, a - width), min(len(line), b + width)
        if sentences:
            begin = max([begin, *(begin + m.end() for m in re.finditer(SENTENCE_END, line[begin:a]))])
            end = min([end, *(b + m.end() for m in re.finditer(SENTENCE_END, line[b:end]))])
        if piece := line[begin:end].strip():
            out.append(piece)
    return out


def attention_snippets(articles: DataFrame, rules: Rules, *, sentences: bool = False, most: int | None = None) -> DataFrame:
    """article_id, position (from 1) and snippet. most keeps the first snippets of each article; without it all stay.

    Whole lines are kept between line breaks; with sentences, windows of long lines end at sentences.
    """
    told = lines(articles).where(rules.tells(F.col("line")) & (stripped(F.col("line")) != ""))
    around = told.withColumn("reach", rules.reach(F.col("line")))
    before = F.slice("before", F.greatest(F.size("before") - F.col("reach") + 1, F.lit(1)), F.col("reach"))
    around = around.select("article_id", "no", "line", before.alias("before"), F.slice("after", F.lit(1), F.col("reach")).alias("after"))
    short = F.length("line") <= LONG_LINE
    whole = stripped(F.array_join(F.concat("before", F.array("line"), "after"), "\n"))
    taken = around.where(short).select("article_id", "no", F.lit(0).alias("k"), whole.alias("snippet"))

    places, width, meet, whole_if_none = rules.places, rules.window, rules.meet, rules.whole_if_none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for article_id, no, line, prev, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = windows(line, places(line), width, meet, sentences)
                if pieces and any([*prev, *following]):
                    pieces[0] = "\n".join(p for p in [*prev, pieces[0], *following] if p).strip()
                if not pieces and whole_if_none:
                    pieces = ["\n".join([*prev, line, *following]).strip()]
                out += [(article_id, no, k, piece) for k, piece in enumerate(pieces)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["article_id", "no", "k", "snippet"])

    long = map_rows(around.where(~short).withColumn("article_id", F.col("article_id").cast("long")), run, "article_id long, no int, k int, snippet string")
    every = taken.withColumn("article_id", F.col("article_id").cast("long")).unionByName(long).where("snippet <> ''")
    first = every.groupBy("article_id", "snippet").agg(F.min(F.struct("no", "k")).alias("at"))
    ranked = first.withColumn("position", F.row_number().over(Window.partitionBy("article_id").orderBy("at")))
    kept = ranked if most is None else ranked.where(F.col("position") <= most)
    return kept.select("article_id", "position", "snippet")


# Patterns of candidate command lines, in the order in which they are tried.
CANDIDATES = (
    r'(?:"?[A-Za-z]:\\+[^"\s]+\.\w{3,4}"?(?:\s+[^\r\n]+))',
    r"(?:[A-Za-z0-9_\-]+\.exe)(?:\s+[^\r\n]+)",
    r"(?:powershell(?:\.exe)?)\s+[^\r\n]+",
    r'(?:"?C:\\+Windows\\+System32\\+(?:net|ipconfig|setspn|quser)\.exe"?\s+[^\r\n]+)',
    r'"[A-Za-z]:\\+[^"\r\n]+?\.\w{3,4}"(?:\s+[^\r\n]+)',
)


def without_variants(found: list[str]) -> list[str]:
    """In order, the texts that aren't part of another: each meets the first kept text that holds it or that it holds, and the longer of both stays there."""
    kept: list[str] = []
    seen: set[str] = set()
    for text in found:
        if not text or text in seen:
            continue
        seen.add(text)  # a text that was met once is part of a kept one, or kept itself, from then on
        at = next((i for i, other in enumerate(kept) if text in other or other in text), None)
        if at is None:
            kept.append(text)
        elif kept[at] in text:
            kept[at] = text
    return kept


def command_candidates(articles: DataFrame, patterns: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """article_id, position (from 1) and candidate: what the patterns match, trimmed, longer variants in place of shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p, re.IGNORECASE | re.MULTILINE) for p in patterns]
        for batch in batches:
            out: list[tuple] = []
            for article_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept = without_variants([m.group(0).strip() for p in compiled for m in p.finditer(text or "")])
                out += [(article_id, i + 1, c) for i, c in enumerate(kept)]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["article_id", "position", "candidate"])

    return map_rows(articles.select(F.col("article_id").cast("long").alias("article_id"), "content"), run, "article_id long, position int, candidate string")


def candidate_lines(candidates: DataFrame, articles: DataFrame, *, context: int = 1) -> DataFrame:
    """Each candidate with its first line in the article: no (from 0), the line and up to so many lines around it."""
    if not 0 <= context <= 2:
        raise ValueError("a line comes with two lines on either side at most")
    where = lines(articles).withColumn("article_id", F.col("article_id").cast("long")).join(candidates, "article_id").where(F.contains("line", F.element_at(F.split("candidate", LINE_ENDS), 1)))
    first = where.groupBy("article_id", "position").agg(F.min_by(F.struct("no", "line", "before", "after"), "no").alias("m"), F.first("candidate").alias("candidate"))
    cut = F.slice("m.before", F.greatest(F.size("m.before") - context + 1, F.lit(1)), context)
    return first.select("article_id", "position", "candidate", F.col("m.no").alias("no"), F.col("m.line").alias("line"), cut.alias("before"), F.slice("m.after", 1, context).alias("after"))
