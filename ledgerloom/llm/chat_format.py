"""Chat formatting [native]: a finite-state machine over roles and a declarative template.

A template gives each role an opening and a closing control string and says whether its text
is trained on. The machine reads the roles of a conversation in turn order and says whether
the order is allowed. The result has the formatted text and its segments, each with a loss flag:
control strings never count, the text of a role under loss does.

Texts are escaped: where a control string stands in a text, with k backslashes before it, k + 1
are written. Control strings of the template always follow a space or another control string,
so inside a text none is bare, and `parse` gets every turn back exactly.

Cases: a null text or role is empty; a role that the template lacks gets a generic turn that
carries its name and fails the machine; rows with equal turn numbers are put in order of role
and text, repeated rows stay; a null turn sorts first; a null conv_id is a conversation of its own; an
empty table gives an empty result; other columns are ignored. A conversation is one output row
and so must fit a task; its turns are gathered by one shuffle on conv_id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import let


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("<s>", "</s>", loss=True),
        }
    )
    #: state -> role -> next state; a missing entry is an error
    machine: dict = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple = ("asked", "answered")
    #: the generic turn of other roles: open, base64 of the role, "]"
    other: Turn = Turn("[TURN:", "[/TURN]")

    def controls(self) -> list[str]:
        return sorted({x for t in (*self.turns.values(), self.other) for x in (t.open, t.close)})


DEFAULT = Template()


def _any_control(template: Template) -> str:
    return "(" + "|".join(re.escape(c) for c in template.controls()) + ")"


def escape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, r"(\\*)" + _any_control(template), r"$1\\$2")


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + _any_control(template), "$1$2")


def _case(role: Column, template: Template, value, other: Column) -> Column:
    out = None
    for name, turn in template.turns.items():
        cond, got = role == name, value(turn)
        out = F.when(cond, got) if out is None else out.when(cond, got)
    return out.otherwise(other)


def segments(turns: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text, loss>>: opening, text and closing of every turn."""

    def of(t: Column) -> Column:
        role = t["role"]
        opening = _case(
            role,
            template,
            lambda x: F.lit(x.open + " "),
            F.concat(F.lit(template.other.open), F.base64(role.cast("binary")), F.lit("] ")),
        )
        closing = _case(role, template, lambda x: F.lit(" " + x.close), F.lit(" " + template.other.close))
        loss = _case(role, template, lambda x: F.lit(x.loss), F.lit(False))

        def seg(text: Column, flag: Column) -> Column:
            return F.struct(role.alias("role"), text.alias("text"), flag.alias("loss"))

        return F.array(
            seg(opening, F.lit(False)), seg(escape(t["text"], template), loss), seg(closing, F.lit(False))
        )

    return F.flatten(F.transform(turns, of))


def order_error(turns: Column, template: Template = DEFAULT) -> Column:
    """Null if the machine accepts; else the position of the first wrong turn, or the number of
    turns if the conversation ends in a state that is not accepting."""
    moves = F.create_map(
        *[F.lit(x) for s, row in template.machine.items() for r, to in row.items() for x in (f"{s}>{r}", to)]
    )

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit(">"), t["role"]))
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            F.when(to.isNotNull(), acc["at"] + 1).otherwise(acc["at"]).alias("at"),
        )

    def stop(acc: Column) -> Column:
        return F.when(~acc["state"].isin(*template.accepting), acc["at"])

    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(0).alias("at")), step, stop)


def parse(formatted: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text>> from formatted text."""
    any_turn = "|".join(
        [f"{re.escape(t.open)} .*? {re.escape(t.close)}" for t in template.turns.values()]
        + [f"{re.escape(template.other.open)}[A-Za-z0-9+/=\\s]*\\] .*? {re.escape(template.other.close)}"]
    )
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s)({any_turn})"), F.lit(1))

    def cut(p: Column, head: Column, close: str) -> Column:
        # text between an opening of head characters and the closing, both with their space
        return F.substring(p, head + 1, F.length(p) - head - len(close) - 1)

    def of(p: Column) -> Column:
        head = F.instr(p, "] ") + 1
        name = F.substring(p, F.lit(len(template.other.open) + 1), head - len(template.other.open) - 2)
        out = None
        for role, t in template.turns.items():
            cond = F.startswith(p, F.lit(t.open + " "))
            got = F.struct(
                F.lit(role).alias("role"),
                unescape(cut(p, F.lit(len(t.open) + 1), t.close), template).alias("text"),
            )
            out = F.when(cond, got) if out is None else out.when(cond, got)
        return out.otherwise(
            F.struct(
                F.unbase64(name).cast("string").alias("role"),
                unescape(cut(p, head, template.other.close), template).alias("text"),
            )
        )

    return F.transform(pieces, of)


def format_conversations(
    rows: DataFrame,
    template: Template = DEFAULT,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, n_turns, formatted, segments, order_error: one row per conversation."""
    gathered = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    gathered = gathered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    done = gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        let(
            segments(F.col("turns"), template),
            lambda s: F.struct(
                F.array_join(F.transform(s, lambda x: x["text"]), "").alias("formatted"), s.alias("segments")
            ),
        ).alias("f"),
        order_error(F.col("turns"), template).alias("order_error"),
    )
    return done.select("conv_id", "n_turns", "f.formatted", "f.segments", "order_error")


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests taken from the output: turns parsed from the text, loss text from the mask."""
    nl = F.lit("\n")
    return formatted.select(
        "conv_id",
        parse(F.col("formatted"), template).alias("turns"),
        F.array_join(
            F.transform(
                F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"], template)
            ),
            "",
        ).alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "order_error",
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "").cast(
                "binary"
            ),
            256,
        ).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("order_error").isNull().alias("valid_order"),
    )
