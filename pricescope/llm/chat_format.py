"""Chat formatting with a finite-state machine over roles and a declarative template. DataFrame operations only.

A template names the text before and after each role's turns, whether the turn's own text is under the loss mask, and the
machine that checks the order of turns: (state, role) -> state. A conversation becomes a list of segments ``(text, loss)``, which
joined are the formatted text. A conversation is valid if it never leaves the table and ends in an accepting state;
invalid ones are formatted as well and marked.

Escapes and the way back are derived from the template. Each of its control strings holds a special character, its first
punctuation (or else its first line break or tab); inside texts these characters, and the ampersand, are written as entities. So no
control string occurs in a text, and a formatted text is read turn by turn: a control string, a run without special
characters, a control string. ``Template`` refuses strings that can't be told apart that way.

Defined cases: null texts are empty; rows are ordered by turn, then role and text (null first), and repeated rows are turns of
their own; a role that the template doesn't name, null (as an empty name) included, gets the template's general turn, without loss;
rows with a null conversation form one conversation. A conversation is one row of output and so must fit in a task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities with a name; other characters are written by their code.
NAMES = {"&": "amp", "<": "lt", ">": "gt", "[": "lsqb", "]": "rsqb", "|": "vert", "#": "num"}


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


def special(control: str) -> str:
    """The character of a control string that is escaped in texts."""
    marks = [c for c in control if not c.isalnum() and not c.isspace() and c not in "&;"] or [c for c in control if c in "\n\t\r"]
    if not marks:
        raise ValueError(f"{control!r} holds no punctuation that tells it from a text")
    return marks[0]


@dataclass(frozen=True)
class Template:
    """What stands before a conversation, before and after the turns of each role, and which turns may follow which."""

    start: str = "<s>"
    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS] ", " [/SYS]"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn("[OUT] ", " </s>", loss=True),
        }
    )
    other_before: str = "[ROLE {role}] "
    other_after: str = " [/ROLE]"
    #: (state, role) -> state; a conversation starts in "start".
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "asked",
            ("start", "user"): "user",
            ("asked", "user"): "user",
            ("user", "assistant"): "answered",
            ("answered", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        if self.other_before.count("{role}") != 1:
            raise ValueError("other_before names the role once, as {role}")
        opening = [t.before for t in self.turns.values()] + [self.other_parts[0]]
        for i, a in enumerate(opening):
            if any(b.startswith(a) for j, b in enumerate(opening) if j != i):
                raise ValueError(f"{a!r} begins turns of two roles")
        self.entities  # noqa: B018

    @property
    def other_parts(self) -> tuple[str, str]:
        before, _, after = self.other_before.partition("{role}")
        return before, after

    @property
    def entities(self) -> list[tuple[str, str]]:
        """Characters and what is written for them, in the order of escaping."""
        controls = [s for t in self.turns.values() for s in (t.before, t.after)] + [*self.other_parts, self.other_after]
        marks = {special(s) for s in controls} | ({special(self.start)} if self.start else set())
        return [(c, f"&{NAMES.get(c, f'u{ord(c):x}')};") for c in ["&", *sorted(marks)]]

    @property
    def turn_pattern(self) -> str:
        """A turn of a formatted text."""
        text = f"[^{''.join(re.escape(c) for c, _ in self.entities if c != '&')}]*"
        named = [f"{re.escape(t.before)}{text}{re.escape(t.after)}" for t in self.turns.values()]
        return "(?s)" + "|".join([*named, f"{re.escape(self.other_parts[0])}{text}{re.escape(self.other_parts[1])}{text}{re.escape(self.other_after)}"])


def escape(text: Column, template: Template) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), template.entities, text)


def unescape(text: Column, template: Template) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(template.entities), text)


def _segments(turn: Column, template: Template) -> Column:
    role = F.coalesce(turn["role"], F.lit(""))
    parts = template.other_parts
    before = F.concat(F.lit(parts[0]), escape(role, template), F.lit(parts[1]))
    after, loss = F.lit(template.other_after), F.lit(False)
    for name, t in template.turns.items():
        before = F.when(role == name, F.lit(t.before)).otherwise(before)
        after = F.when(role == name, F.lit(t.after)).otherwise(after)
        loss = F.when(role == name, F.lit(t.loss)).otherwise(loss)
    part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    return F.array(part(before, F.lit(False)), part(escape(turn["text"], template), loss), part(after, F.lit(False)))


def final_state(roles: Column, template: Template) -> Column:
    """The state in which the roles leave the machine; null once a role has no transition."""
    table = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state} {role}", to)])
    return F.aggregate(roles, F.lit("start"), lambda state, role: _next(table, state, role))


def _next(table: Column, state: Column, role: Column) -> Column:
    return F.try_element_at(table, F.concat(F.coalesce(state, F.lit("invalid")), F.lit(" "), F.coalesce(role, F.lit(""))))


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, valid, segments and formatted text of every conversation."""
    template = template or Template()
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    state = final_state(F.transform("turns", lambda t: t["role"]), template)
    opened = F.array(F.struct(F.lit(template.start).alias("text"), F.lit(False).alias("loss")))
    segmented = grouped.select(
        "conv_id",
        F.coalesce(state.isin(*template.accepting), F.lit(False)).alias("valid"),
        F.concat(opened, F.flatten(F.transform("turns", lambda t: _segments(t, template)))).alias("segments"),
    )
    return segmented.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted text, from the text alone."""
    template = template or Template()
    turns = F.regexp_extract_all(F.substring(formatted, len(template.start) + 1, 2**31 - 1), F.lit(template.turn_pattern), F.lit(0))

    def between(text: Column, before: Column, after: str) -> Column:
        return F.substring(text, before + 1, F.length(text) - before - len(after))

    def turn(text: Column) -> Column:
        head, tail = template.other_parts
        named = F.split_part(F.substring(text, len(head) + 1, 2**31 - 1), F.lit(tail), F.lit(1))
        role, body = unescape(named, template), between(text, F.length(named) + len(head) + len(tail), template.other_after)
        for name, t in template.turns.items():
            here = F.startswith(text, F.lit(t.before))
            role = F.when(here, F.lit(name)).otherwise(role)
            body = F.when(here, between(text, F.lit(len(t.before)), t.after)).otherwise(body)
        return F.struct(role.alias("role"), unescape(body, template).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
