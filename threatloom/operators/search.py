"""Boolean, wildcard and lexical search as column predicates, and the validator of read-only SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    text: str
    operator: str  # DEFAULT, AND, OR or NOT
    wildcard: bool = False


def parse_query(query: str | None) -> list[Term]:
    """Quoted phrases come first; an operator holds for all terms after it; parentheses mean nothing.

    A single plain term beside an OR, and two or more plain terms, count as OR.
    """
    rest = query or ""
    words = re.findall(r'"[^"]*"|[^\s()"]+', rest)
    quoted = [w[1:-1].strip() for w in words if w.startswith('"')]
    terms = [Term(q.lower(), "DEFAULT", any(c in q for c in "*?[")) for q in quoted if q]
    operator = "DEFAULT"
    for w in (w for w in words if not w.startswith('"')):
        if w.upper() in ("AND", "OR", "NOT"):
            operator = w.upper()
        else:
            terms.append(Term(w.lower(), operator, any(c in w for c in "*?[")))
    plain = [t for t in terms if t.operator == "DEFAULT"]
    if len(plain) > 1 or plain and any(t.operator == "OR" for t in terms):
        terms = [Term(t.text, "OR", t.wildcard) if t.operator == "DEFAULT" else t for t in terms]
    return terms


def wildcard_regex(pattern: str) -> str:
    """*, ?, [set] and [!set] of a word, as a regular expression for whole words."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def term_matches(term: Term, fields: list[Column]) -> Column:
    if term.wildcard:
        pattern = wildcard_regex(term.text)
        hit = lambda c: F.exists(F.regexp_extract_all(c, F.lit(r"(?U)\b\w+\b"), F.lit(0)), lambda w: w.rlike(pattern))
    else:
        hit = lambda c: F.contains(c, F.lit(term.text))
    return reduce(lambda a, b: a | b, (hit(F.lower(F.coalesce(f, F.lit("")))) for f in fields))


def query_predicate(query: str | None, fields: list[Column]) -> Column:
    """One predicate for the whole query; an empty query matches everything."""
    terms = [(t, term_matches(t, fields)) for t in parse_query(query)]
    must = [m for t, m in terms if t.operator in ("AND", "DEFAULT")]
    some = [m for t, m in terms if t.operator == "OR"]
    never = [~m for t, m in terms if t.operator == "NOT"]
    parts = [*must, *never, *([reduce(lambda a, b: a | b, some)] if some else [])]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def boolean_search(articles: DataFrame, query: str | None) -> DataFrame:
    return articles.where(query_predicate(query, [F.col("title"), F.col("content")]))


def lexical_search(articles: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """Any term in title or content, whatever the case; newest first, content cut for display."""
    hit = reduce(lambda a, b: a | b, (F.ilike(c, F.lit(f"%{t}%")) for t in terms for c in (F.col("title"), F.col("content"))))
    cut = F.when(F.length("content") > 500, F.concat(F.substring("content", 1, 500), F.lit("..."))).otherwise(F.col("content"))
    found = articles.where(hit).orderBy(F.desc("discovered_at"), F.desc("article_id")).limit(limit)
    return found.select("article_id", "source", cut.alias("content"), F.lit(0.35).alias("similarity"))


# Words that a read-only statement may not hold, and patterns of injected code.
FORBIDDEN = (
    "INSERT UPDATE DELETE DROP CREATE ALTER TRUNCATE GRANT REVOKE COMMIT ROLLBACK SAVEPOINT EXECUTE EXEC CALL DECLARE SET BEGIN END IF WHILE FOR LOOP "
    "FUNCTION PROCEDURE TRIGGER INDEX VIEW"
).split()
DANGEROUS = (
    r";\s*(DROP|DELETE|INSERT|UPDATE|CREATE|ALTER)", r"--", r"/\*.*?\*/", r"UNION\s+SELECT", r"OR\s+1\s*=\s*1", r"AND\s+1\s*=\s*1", r"EXEC\s*\(", r"xp_", r"sp_", r"@@",
    r"CHAR\s*\(", r"ASCII\s*\(", r"SUBSTRING\s*\(", r"CONCAT\s*\(",
)


def sql_verdict(sql: Column) -> Column:
    """Why a statement isn't accepted as read-only (empty, forbidden_word, dangerous_pattern, not_select), or 'ok'."""
    plain = F.upper(F.trim(F.coalesce(sql, F.lit(""))))
    return (
        F.when(plain == "", "empty")
        .when(plain.rlike(r"\b(" + "|".join(FORBIDDEN) + r")\b"), "forbidden_word")
        .when(plain.rlike("(?i)" + "|".join(DANGEROUS)), "dangerous_pattern")
        .when(~F.startswith(plain, F.lit("SELECT")), "not_select")
        .otherwise("ok")
    )


def sql_complexity(sql: Column) -> Column:
    """Counts of the parts of a statement without its comments."""
    plain = F.upper(F.trim(F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")))
    count = lambda w: F.regexp_count(plain, F.lit(rf"\b{w}\b"))
    return F.struct(*(count(w).alias(w.lower().replace(" ", "_")) for w in ("SELECT", "JOIN", "WHERE", "GROUP BY", "ORDER BY")))
