"""Chat formatting: a finite-state machine checks the order of turns, a declarative template writes
each turn as segments with a loss flag.

Every control string of a template starts with one of a few characters. Inside roles and texts the
escape character follows each of those characters and each escape character, so no control string
can appear there and reading back is exact.

Defined results: a null role or text counts as empty; turns are ordered by number (null first), then
role, then text, and repeated rows stay; rows without a conv_id form one conversation; a conversation
that breaks the order is formatted all the same, with ``valid`` false and its first bad turn. One
conversation is one training example and has to fit in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    """What surrounds a turn, who is trained on, and which roles may follow in which state."""

    open: str = "<|turn|>"
    middle: str = "<|text|>"
    close: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    #: state -> role -> next state; what is missing is an error
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "begin": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    accepting: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        marks = (self.open, self.middle, self.close)
        if any(len(m) < 2 or m[1] == ESCAPE or m[0] == ESCAPE for m in marks) or len(set(marks)) < 3:
            raise ValueError("control strings need two characters at least, no early escape, and must differ")

    @property
    def leads(self) -> str:
        """A regex class of the characters that get an escape."""
        found = sorted({m[0] for m in (self.open, self.middle, self.close)} | {ESCAPE})
        return "[" + "".join(re.escape(c) for c in found) + "]"


def escape(text: Column, template: ChatTemplate) -> Column:
    return F.regexp_replace(text, f"({template.leads})", "$1\\\\")


def unescape(text: Column, template: ChatTemplate) -> Column:
    return F.regexp_replace(text, f"({template.leads})\\\\", "$1")


def _check(turns: Column, template: ChatTemplate) -> Column:
    """Run the machine over the roles: (state, first turn it refused)."""
    arrows = [
        F.lit(part)
        for state, moves in template.moves.items()
        for role, to in moves.items()
        for part in (f"{state}\n{role}", to)
    ]
    table = F.create_map(*arrows)

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("\n")).alias("state"),  # a state no arrow leaves: all that follows is refused
            (acc["seen"] + 1).alias("seen"),
            F.when((acc["bad"] < 0) & to.isNull(), acc["seen"]).otherwise(acc["bad"]).alias("bad"),
        )

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("seen"), F.lit(-1).alias("bad"))
    return F.aggregate(turns, begin, step)


def format_chat(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: id, segments (turn, text, loss), formatted, valid, bad_turn.

    ``formatted`` is the segments one after the other.
    """
    template = template or ChatTemplate()
    grouped = (
        turns.select(
            F.col(conv_col).alias("conv_id"),
            F.struct(
                F.col(turn_col).alias("turn"),
                F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
            ).alias("row"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("row")).alias("turns"))
    )

    def segment(number: Column, text: Column, loss: Column) -> Column:
        return F.struct(number.cast("int").alias("turn"), text.alias("text"), loss.alias("loss"))

    def write(turn: Column, number: Column) -> Column:
        no = F.lit(False)
        head = F.concat(F.lit(template.open), escape(turn["role"], template), F.lit(template.middle))
        return F.array(
            segment(number, head, no),
            segment(number, escape(turn["text"], template), turn["role"].isin(list(template.loss_roles))),
            segment(number, F.lit(template.close), no),
        )

    checked = grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", write)).alias("segments"),
        _check(F.col("turns"), template).alias("end"),
    )
    return checked.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("end.state").isin(list(template.accepting)).alias("valid"),
        F.when(F.col("end.bad") >= 0, F.col("end.bad")).alias("bad_turn"),
    )


def read_chat(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) of a formatted conversation."""
    template = template or ChatTemplate()
    parts = F.split(formatted, re.escape(template.open), -1)

    def turn(part: Column) -> Column:
        both = F.split(part, re.escape(template.middle), 2)
        text = F.regexp_replace(F.get(both, F.lit(1)), re.escape(template.close) + r"\z", "")
        return F.struct(
            unescape(F.get(both, F.lit(0)), template).alias("role"), unescape(text, template).alias("text")
        )

    return F.transform(F.slice(parts, 2, F.size(parts)), turn)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    template = template or ChatTemplate()
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"], template)), "")
