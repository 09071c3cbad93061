"""Licence scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser reads expressions.

A text is lower-cased (A-Z only) and cut into words; one automaton runs over the words joined by
single spaces and finds, in one pass, every phrase of the table and every identifier tag. After a
tag, the expression on the same line is parsed to reverse Polish order and evaluated: an identifier
has its family and its permissiveness, OR takes the most permissive side, AND the least, and WITH an
exception moves its licence half-way to permissive. An identifier that isn't in the table is a label of its own.

score is the evidence for a licence: 1 - 2 ** -(notices + 2 * valid expressions), 0 without any.

Defined cases: a null or empty text has no words, no labels and score 0; overlapping phrases all
count; an expression that doesn't parse, or names no identifier, gives no label; repeated rows are scanned each on its own;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import lower_ascii_py, map_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases that the base counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further phrases of the method.
MORE = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "gnu lgpl": "lgpl", "affero general public license": "agpl", "gnu agpl": "agpl", "gnu gpl": "gpl", "gplv2": "gpl", "gplv3": "gpl", "lgplv2": "lgpl", "lgplv3": "lgpl",
    "gnu free documentation license": "gfdl", "mozilla public license": "mpl", "eclipse public license": "epl", "eclipse distribution license": "bsd", "common development and distribution license": "cddl", "common public license": "cpl",
    "european union public licence": "eupl", "microsoft public license": "ms-pl", "microsoft reciprocal license": "ms-rl", "artistic license": "artistic", "boost software license": "bsl", "zlib license": "zlib", "zlib libpng license": "zlib",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "simplified bsd": "bsd", "revised bsd": "bsd", "redistribution and use in source and binary forms": "bsd", "neither the name of": "bsd",
    "isc license": "isc", "permission to use copy modify and or distribute this software": "isc", "permission is hereby granted free of charge": "mit", "licensed under the mit": "mit", "licensed under the apache": "apache", "apache software license": "apache", "apache software foundation": "apache",
    "python software foundation license": "psf", "psf license": "psf", "php license": "php", "ruby license": "ruby", "openssl license": "openssl", "w3c software notice": "w3c", "unicode license": "unicode", "postgresql license": "postgresql", "sil open font license": "ofl", "open font license": "ofl",
    "unlicense": "unlicense", "do what the fuck you want to public license": "wtfpl", "wtfpl": "wtfpl", "public domain": "public-domain", "creative commons": "cc", "cc by": "cc", "cc0": "cc0", "open database license": "odbl", "odc by": "odc-by",
    "server side public license": "sspl", "business source license": "busl", "elastic license": "elastic", "commons clause": "commons-clause", "all rights reserved": "proprietary", "proprietary and confidential": "proprietary", "for internal use only": "proprietary",
}
TAG = "spdx license identifier"
EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")
#: Families by the prefix of an identifier, with how permissive they are.
FAMILIES = (
    ("mit-0", "mit", 1.0), ("mit", "mit", 1.0), ("x11", "mit", 1.0), ("expat", "mit", 1.0), ("0bsd", "bsd", 1.0), ("bsd", "bsd", 1.0), ("isc", "isc", 1.0), ("zlib", "zlib", 1.0), ("bsl", "bsl", 1.0), ("unlicense", "unlicense", 1.0), ("wtfpl", "wtfpl", 1.0), ("cc0", "cc0", 1.0), ("pddl", "pddl", 1.0),
    ("postgresql", "postgresql", 1.0), ("ncsa", "ncsa", 1.0), ("python", "psf", 0.95), ("psf", "psf", 0.95), ("php", "php", 0.9), ("ruby", "ruby", 0.9), ("openssl", "openssl", 0.9), ("w3c", "w3c", 0.95), ("unicode", "unicode", 0.95), ("apache", "apache", 0.95), ("ms-pl", "ms-pl", 0.8), ("artistic", "artistic", 0.8), ("ofl", "ofl", 0.8), ("afl", "afl", 0.8),
    ("cc-by-nc", "cc", 0.1), ("cc-by-nd", "cc", 0.2), ("cc-by-sa", "cc", 0.5), ("cc-by", "cc", 0.8), ("odc-by", "odc-by", 0.8), ("odbl", "odbl", 0.5), ("mpl", "mpl", 0.6), ("epl", "epl", 0.6), ("cddl", "cddl", 0.6), ("cpl", "cpl", 0.6), ("eupl", "eupl", 0.4), ("ms-rl", "ms-rl", 0.5), ("osl", "osl", 0.3),
    ("lgpl", "lgpl", 0.5), ("gfdl", "gfdl", 0.3), ("agpl", "agpl", 0.1), ("gpl", "gpl", 0.2), ("sspl", "sspl", 0.05), ("busl", "busl", 0.05), ("elastic", "elastic", 0.05),
)
#: What an identifier that isn't in the table looks like; it is a label of its own and says nothing about permissiveness.
UNKNOWN = re.compile(r"licenseref-[a-z0-9.-]+|[a-z][a-z0-9.+]*-[a-z0-9.+-]*[0-9][a-z0-9.+-]*")
PRIORITY = {"or": 1, "and": 2, "with": 3}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>, permissive double"
)


def to_polish(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's tokens in reverse Polish order; None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand must come next
    for token in TOKEN.findall(expression):
        if token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break  # closes something before the expression
            stack.pop()
        elif token in PRIORITY:
            if operand:
                return None
            while stack and stack[-1] != "(" and PRIORITY[stack[-1]] >= PRIORITY[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif operand:
            out.append(token)
            operand = False
        else:
            break  # a second operand: prose follows
    if operand or "(" in stack:
        return None
    return [*out, *reversed(stack)]


def evaluate(polish: list[str]) -> tuple[set[str], float | None]:
    """The labels that an expression names, and its permissiveness, None if no part of it has one."""
    stack: list[tuple[set[str], float | None]] = []
    for token in polish:
        if token in PRIORITY:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, None if a is None else a + (1 - a) / 2))
            else:
                known = [x for x in (a, b) if x is not None]
                stack.append((left | right, (max if token == "or" else min)(known) if known else None))
        else:
            family = next(((f, p) for prefix, f, p in FAMILIES if re.match(rf"{re.escape(prefix)}(?![a-z])", token)), None)
            stack.append(({family[0]}, family[1]) if family else ({token} if UNKNOWN.fullmatch(token) else set(), None))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**BASE, **MORE, TAG: ""}.items():
        found.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    found.make_automaton()
    return found


def scan(text: str | None, found: ahocorasick.Automaton) -> tuple:
    lowered = lower_ascii_py(text)
    words = WORD.findall(lowered)
    joined = f" {' '.join(words)} "
    starts, base, labels, notices, tagged = [], set(), set(), 0, False
    for end, (phrase, label, is_base) in found.iter(joined):
        if phrase == TAG:
            tagged = True
            continue
        labels.add(label)
        notices += 1
        if is_base:
            base.add(label)
            starts.append(end - len(phrase) - 1)  # of the space before it
    at = [joined.count(" ", 0, s) for s in (min(starts), max(starts))] if starts else [None, None]
    expressions, permissive = [], None
    for m in EXPRESSION.finditer(lowered) if tagged else ():
        if polish := to_polish(m[1]):
            families, value = evaluate(polish)
            if not families:
                continue  # prose after the tag
            labels |= families
            expressions.append(" ".join(polish))
            permissive = value if permissive is None else permissive if value is None else min(permissive, value)
    score = 1 - 0.5 ** min(50, notices + 2 * len(expressions))
    return len(words), len(starts), *at, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, permissive


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each document; the scan stays in the document's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.float64()]
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scan(t, found) for t in batch.column(1).to_pylist()]
            cols = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], type=k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
