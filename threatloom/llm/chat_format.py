"""Chat training examples by prefix-target expansion.

A conversation becomes one transcript, written turn by turn as a segment
`<|im_start|>role<|im_sep|>text<|im_end|>`. Roles and texts are escaped reversibly: a backslash, `<`
and `[` become `\\b`, `\\l` and `\\s`, so no control string of this or another template can stand in
a text. Every assistant turn is an example of its own: all segments before it are its prefix, the turn
is its target, and only the target's text is under the loss mask. expand() writes each example out in a
row of its own, which grows with the square of a conversation's turns; no row is kept beyond its step.

Defined cases: turns are ordered by turn, then role, then text, nulls first; a null text or role is
empty; a null conv_id is a conversation of its own; repeated rows are repeated turns; a conversation
without an assistant turn has a transcript and no examples; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: In this order; undone in the reverse one.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"))


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, segments array<string>, examples array<struct<target, loss_start, loss_chars>>.

    target counts the segments before the reply; loss_start is from 1 inside the target segment.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    written = grouped.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END)).alias("segment"),
                (t["role"] == "assistant").alias("trained"),
            ),
        ).alias("w"),
    )
    head = len(START) + len("assistant") + len(SEP)
    indexed = F.transform(F.col("w"), lambda x, i: F.struct(i.alias("i"), F.length(x["segment"]).alias("n"), x["trained"].alias("trained")))
    return written.select(
        "conv_id",
        F.col("w.segment").alias("segments"),
        F.transform(
            F.filter(indexed, lambda x: x["trained"]),
            lambda x: F.struct(
                x["i"].alias("target"), F.lit(head + 1).alias("loss_start"), (x["n"] - F.lit(head + len(END))).alias("loss_chars")
            ),
        ).alias("examples"),
    )


def written_out(formatted: DataFrame) -> DataFrame:
    """A row for each example with its context as text; the loss mask counts inside the target."""
    return formatted.select("conv_id", "segments", F.posexplode("examples").alias("example", "e")).select(
        "conv_id",
        "example",
        F.array_join(F.slice("segments", F.lit(1), F.col("e.target")), "").alias("context"),
        F.element_at("segments", F.col("e.target") + 1).alias("target"),
        F.col("e.loss_start").alias("loss_start"),
        F.col("e.loss_chars").alias("loss_chars"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """The training examples: conv_id, example, text (prefix and target written out), and the loss mask in it (from 1). Grows with the square of a conversation's turns."""
    return written_out(formatted).select(
        "conv_id",
        "example",
        F.concat("context", "target").alias("text"),
        (F.length("context") + F.col("loss_start")).alias("loss_start"),
        "loss_chars",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted segments and, from the text of each expanded example, the loss masks hold, unescaped."""

    def turn(segment: Column) -> Column:
        body = F.substring(segment, F.lit(len(START) + 1), F.length(segment) - len(START) - len(END))
        role = unescape(F.substring_index(body, SEP, 1))
        text = unescape(F.substring_index(body, SEP, -1))
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    loss = unescape(F.substring("text", F.col("loss_start"), F.col("loss_chars")))
    examples = expand(formatted).select("conv_id", F.struct("example", loss.alias("loss")).alias("e")).groupBy("conv_id")
    examples = examples.agg(F.array_sort(F.collect_list("e")).alias("e"), F.count(F.lit(1)).alias("n_examples"))
    examples = examples.select(F.col("conv_id").alias("_conv"), F.array_join("e.loss", "").alias("_loss"), "n_examples")
    turns = formatted.select(
        "conv_id",
        F.size("segments").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("segments", turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s)).alias("formatted_chars"),
    )
    _loss = F.coalesce("_loss", F.lit(""))
    return turns.join(examples, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length(_loss).cast("long").alias("loss_chars"),
        F.sha2(_loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.coalesce("n_examples", F.lit(0).cast("long")).alias("n_examples"),
    )
