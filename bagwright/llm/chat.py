"""Chat formatting: a role automaton and a declarative template, in DataFrame functions only.

A ``ChatTemplate`` names the marks around a turn, the roles under the loss mask and the automaton
of legal turn orders. ``format_chat`` returns one row per conversation with

* ``segments``: array of (text, loss) whose texts, joined, are the formatted conversation;
* ``formatted``: that joined text;
* ``end_state`` and ``valid``: where the automaton stopped, and whether that state accepts.

Control strings inside a text are escaped so that the output can be read back exactly
(``read_back``): the escape character is followed by "0" for itself, by "1" where it breaks a
control string after its first character, and by "2" for a line break inside a role.

Every per-turn step (escaping, marking) runs before the shuffle. Turns meet in two steps: blocks of
neighbouring turns first, conversations after that, so the automaton runs per block (each block is
a function from entry state to exit state) and a very long conversation is sorted in pieces. The
formatted conversation itself is one value and therefore one row.

Defined results: null text or role is empty; a role unknown to the template leads to the state
"error" (the turn is still formatted, without loss); a null turn comes first; equal turns are
ordered by role, then text, and repeated rows all stay; a null conv_id is a conversation of its
own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "error"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, loss roles and the automaton over roles; ``moves`` maps (state, role) to a state."""

    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    moves: dict = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )

    def __post_init__(self):
        marks = [m for m in (self.turn_start, self.turn_end) if m]
        if not marks or any(self.escape in c for c in (*self.control, *marks)) or len(self.escape) != 1:
            raise ValueError("marks are needed, and the escape must be one character outside all control strings")
        if not any(self.turn_start == c for c in self.control) or not any(self.turn_end.startswith(c) for c in self.control):
            raise ValueError("the marks must be control strings, else texts could imitate them")
        for c in self.control:
            if any(m.startswith(c[i:]) for i in range(1, len(c)) for m in (*marks, *self.control)):
                raise ValueError(f"{c!r} could arise across the border of a text and a mark")

    @property
    def states(self) -> list[str]:
        return sorted({self.start, ERROR, *(s for s, _ in self.moves), *self.moves.values()})


def escaped(text: Column, t: ChatTemplate, role: bool = False) -> Column:
    """``text`` with the escape character, control strings and (in a role) line breaks made harmless."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(t.escape), F.lit(f"{t.escape}0"))
    broken = "|".join(re.escape(c) for c in sorted(t.control, key=len, reverse=True))
    quoted = t.escape.replace("\\", "\\\\").replace("$", "\\$")
    out = F.regexp_replace(out, F.lit(f"(?s)(?={broken})(.)"), F.lit(f"$1{quoted}1"))
    return F.replace(out, F.lit(t.role_end), F.lit(f"{t.escape}2")) if role else out


def unescaped(text: Column, t: ChatTemplate) -> Column:
    """The inverse of ``escaped``."""
    for code, plain in (("2", t.role_end), ("1", ""), ("0", t.escape)):
        text = F.replace(text, F.lit(f"{t.escape}{code}"), F.lit(plain))
    return text


def _step(t: ChatTemplate):
    table = F.create_map(*[F.lit(x) for (s, r), to in sorted(t.moves.items()) for x in (f"{s}|{r}", to)])
    return lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("|"), role)), F.lit(ERROR))


def format_chat(turns: DataFrame, template: ChatTemplate | None = None, block: int = 64) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text); see the module's text."""
    t = template or ChatTemplate()
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / block).alias("block"),
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.concat(F.lit(t.turn_start), escaped(role, t, role=True), F.lit(t.role_end)).alias("head"),
            escaped(F.col("text"), t).alias("body"),
            role.isin(*t.loss_roles).alias("loss"),
        ).alias("t"),
    )
    step = _step(t)
    exits = F.array(*[F.struct(F.lit(s).alias("enter"), F.aggregate("turns", F.lit(s), lambda acc, x: step(acc, x["role"])).alias("leave")) for s in t.states])
    blocks = (
        rows.groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            F.struct(
                "block",
                F.map_from_entries(exits).alias("exits"),
                F.transform("turns", lambda x: F.struct(x["head"].alias("head"), x["body"].alias("body"), x["loss"].alias("loss"))).alias("turns"),
            ).alias("b"),
        )
    )
    whole = blocks.groupBy("conv_id").agg(F.collect_list("b").alias("bs"))
    by_block = lambda a, b: F.when(a["block"].isNull(), -1).when(b["block"].isNull(), 1).when(a["block"] < b["block"], -1).when(a["block"] > b["block"], 1).otherwise(0)
    plain = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(plain(x["head"]), F.struct(x["body"].alias("text"), x["loss"].alias("loss")), plain(F.lit(t.turn_end)))))
    return (
        whole.select("conv_id", F.array_sort("bs", by_block).alias("bs"))
        .select(
            "conv_id",
            F.flatten(F.transform("bs", lambda b: b["turns"])).alias("turns"),
            F.aggregate("bs", F.lit(t.start), lambda s, b: F.element_at(b["exits"], s)).alias("end_state"),
        )
        .select("conv_id", segments.alias("segments"), "end_state")
        .select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "end_state", F.col("end_state").isin(*t.accepting).alias("valid"))
    )


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Parse ``formatted`` again: adds ``turns`` (array of role, text) and ``loss_text``, both unescaped."""
    t = template or ChatTemplate()
    chunks = F.split("formatted", re.escape(t.turn_start), -1)
    head = lambda c: F.substring_index(c, t.role_end, 1)

    def turn(c: Column) -> Column:
        start = F.length(head(c)) + F.lit(1 + len(t.role_end))
        body = F.substr(c, start, F.length(c) - start + F.lit(1 - len(t.turn_end)))
        return F.struct(unescaped(head(c), t).alias("role"), unescaped(body, t).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t))
    return formatted.withColumns({"turns": F.transform(F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0))), turn), "loss_text": F.array_join(loss, "")})
