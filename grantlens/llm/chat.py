"""Chat formatting in SQL functions: a finite-state machine over roles and segments with loss flags.

A template declares which role may follow which, how a turn is marked, and which role is learned. The
machine's state is the role of the turn before, so each turn is judged and written on its own row; no
conversation is gathered to format it. Control strings inside texts and roles are escaped: a backslash
becomes two, and `<|` becomes `<\\|`, so that no marker can be forged and the text can be read back.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = ""


class Template(NamedTuple):
    opening: str
    after_role: str
    closing: str
    learned: tuple[str, ...]
    #: Roles that may follow each role; the empty role stands for the start.
    follows: tuple[tuple[str, tuple[str, ...]], ...]
    last: tuple[str, ...]


CHATML = Template(
    "<|im_start|>", "\n", "<|im_end|>\n", ("assistant",),
    ((NONE, ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user", "tool")), ("tool", ("assistant", "tool"))),
    ("assistant",),
)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    """As a text, and on one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def segments(turns: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: (conv, turn_no from 0, segments array<struct<text, loss>>, allowed, closes).

    Turns go by turn, ties by role and text, nulls first; a null role or text is empty. Every turn is
    written whatever the machine says: `allowed` is whether this role may follow the one before, and
    `closes` whether a conversation may end here. Rows without conv are one conversation.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                        F.coalesce(text, F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = F.coalesce(F.lag("role").over(order), F.lit(NONE))
    steps = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("role")) for a, follow in template.follows for b in follow])
    loss = F.col("role").isin(*template.learned)
    piece = lambda t, flag: F.struct(t.alias("text"), flag.alias("loss"))
    made = F.array(
        piece(F.concat(F.lit(template.opening), escaped_role(F.col("role")), F.lit(template.after_role)), F.lit(False)),
        piece(escaped(F.col("text")), loss),
        piece(F.lit(template.closing), F.lit(False)),
    )
    numbered = rows.withColumn("turn_no", F.row_number().over(order) - 1).withColumn("before", before)
    return numbered.select(
        F.col("conv").alias(conv), "turn_no", made.alias("segments"),
        F.array_contains(steps, F.struct("before", "role")).alias("allowed"), F.col("role").isin(*template.last).alias("closes"),
    )


def conversations(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, segments, valid): all segments of each conversation in order, and the machine's verdict."""
    one = parts.select(conv, F.struct("turn_no", "segments", "allowed", "closes").alias("t"))
    kept = one.groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return kept.select(
        conv, F.expr("flatten(transform(ts, t -> t.segments))").alias("segments"),
        F.expr("forall(ts, t -> t.allowed) AND element_at(ts, -1).closes").alias("valid"),
    )


def read_back(written: DataFrame, template: Template = CHATML, conv: str = "conv_id") -> DataFrame:
    """(conv, turns array<struct<role, text>>, loss_text, formatted_chars, valid), read from the segments alone.

    Turns are found in the joined text by its markers; what is learned, by the segments' flags.
    """
    joined = written.select(
        conv, "valid", F.expr("array_join(transform(segments, s -> s.text), '')").alias("whole"),
        F.expr("array_join(transform(filter(segments, s -> s.loss), s -> s.text), '')").alias("mask"))
    bodies = F.split("whole", "\\Q" + template.closing + "\\E", -1)
    body = F.transform(F.slice(bodies, F.lit(1), F.size(bodies) - 1), lambda b: F.substr(b, F.lit(len(template.opening) + 1)))
    cut = F.transform(body, lambda b: F.struct(F.substring_index(b, template.after_role, 1).alias("role"), b.alias("all")))
    turns = F.transform(cut, lambda c: F.struct(
        unescaped_role(c["role"]).alias("role"),
        unescaped(F.substr(c["all"], F.length(c["role"]) + len(template.after_role) + 1)).alias("text")))
    return joined.select(conv, turns.alias("turns"), unescaped(F.col("mask")).alias("loss_text"),
                         F.length("whole").cast("long").alias("formatted_chars"), "valid")


def digest(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The contract's columns."""
    return read.select(
        conv, F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars", "valid",
    )
