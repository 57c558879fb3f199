"""Chat formatting from a declarative template; DataFrame functions only.

A finite-state machine over the roles (state, role -> state) validates the
order of the turns; every turn becomes three segments (opening mark, text,
closing mark) with a loss flag each, and the segments laid end to end are the
formatted text. Control strings inside a text are escaped: a run of
backslashes after its first character grows by one, which reading back takes
off again, so texts survive whatever they say.

A conversation is one row (its formatted text is one value); its turns are
gathered in one aggregation by conversation, and everything else is narrow.

Defined cases: null texts and null roles are empty; turns sort by turn, then
role, then text (null turns first), so ties have one order; a repeated row is
a turn of its own; roles outside the template are kept under their own name
and make the order invalid; each row with a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, loss and allowed order of the roles. ``other`` renders roles it does not name."""

    #: role: (opening mark, closing mark, whether the text counts for the loss)
    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]\n", False),
        "user": ("<s>[INST] ", " [/INST]\n", False),
        "assistant": ("[ANS] ", " </s>\n", True),
    })
    other: tuple[str, str] = ("[ROLE] ", " [/ROLE]\n")
    #: Strings that a text must not contain as they are; no one begins inside another.
    controls: tuple[str, ...] = ("[SYS]", "[/SYS]", "<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]")
    #: state: {role: next state}; a conversation is valid if it ends in one of ``final``.
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    final: tuple[str, ...] = ("assistant",)

    def rests(self) -> dict[str, str]:
        """First character of the control strings: pattern of what follows it."""
        out: dict[str, list[str]] = {}
        for c in self.controls:
            out.setdefault(c[0], []).append(re.escape(c[1:]))
        return {first: "|".join(rest) for first, rest in out.items()}

    def turn_pattern(self) -> str:
        """One rendered turn; group i is the text of the i-th role, the last group that of other roles."""
        marks = [*((a, b) for a, b, _ in self.roles.values()), self.other]
        return "(?s)" + "|".join(f"{re.escape(a)}(.*?){re.escape(b)}" for a, b in marks)


def escape(text: Column, t: Template) -> Column:
    """The run of backslashes (none, mostly) inside a control string grows by one."""
    return F.regexp_replace(text, "|".join(rf"(?<={re.escape(a)})\\*(?={rest})" for a, rest in t.rests().items()), r"$0\\")


def unescape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, "|".join(rf"(?<={re.escape(a)})\\(?=\\*(?:{rest}))" for a, rest in t.rests().items()), "")


def _role_line(role: Column) -> Column:
    """A role's name without line breaks; reversible."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def _role_of(line: Column) -> Column:
    return F.replace(F.replace(line, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _by_role(role: Column, t: Template, pick, other: Column) -> Column:
    out = F.when(F.lit(False), other)
    for name, marks in t.roles.items():
        out = out.when(role == name, pick(marks))
    return out.otherwise(other)


def _segments(turn: Column, t: Template) -> Column:
    """Opening mark, text and closing mark of a turn with their loss flags."""
    role = turn["role"]
    body = F.when(role.isin(list(t.roles)), escape(turn["text"], t)).otherwise(
        F.concat(escape(_role_line(role), t), F.lit("\n"), escape(turn["text"], t)))
    no = F.lit(False)
    return F.array(
        F.struct(_by_role(role, t, lambda m: F.lit(m[0]), F.lit(t.other[0])).alias("text"), no.alias("loss")),
        F.struct(body.alias("text"), _by_role(role, t, lambda m: F.lit(m[2]), no).alias("loss")),
        F.struct(_by_role(role, t, lambda m: F.lit(m[1]), F.lit(t.other[1])).alias("text"), no.alias("loss")))


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, valid, segments (array of text and loss) and formatted, one row per conversation."""
    t = template or Template()
    steps = F.create_map(*[F.lit(x) for s, moves in t.order.items() for role, to in moves.items() for x in (f"{s}\n{role}", to)])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("turn"))
    # a row without a conversation is one of its own: such rows never meet
    rows = rows.withColumn("own", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    chats = rows.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(
        F.element_at(steps, F.concat(s, F.lit("\n"), x["role"])), F.lit("invalid")))
    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(list(t.final)).alias("valid"),
                         F.flatten(F.transform("turns", lambda x: _segments(x, t))).alias("segments"))
    return chats.withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["text"]), ""))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds turns (array of role and text) and loss_text, both parsed from ``formatted`` and ``segments``."""
    t = template or Template()
    n = len(t.roles) + 1
    parts = [F.regexp_extract_all("formatted", F.lit(t.turn_pattern()), F.lit(i)) for i in range(n + 1)]
    zipped = F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)])

    def turn(x: Column) -> Column:
        role = F.when(F.lit(False), F.lit(""))
        for name, (mark, _, _) in t.roles.items():
            role = role.when(F.startswith(x["g0"], F.lit(mark)), F.lit(name))
        line = F.substring_index(x[f"g{n}"], "\n", 1)
        text = F.concat(*[x[f"g{i}"] for i in range(1, n)], F.expr("''"))
        rest = F.substr(x[f"g{n}"], F.length(line) + 2)
        return F.struct(role.otherwise(_role_of(unescape(line, t))).alias("role"),
                        unescape(F.when(F.startswith(x["g0"], F.lit(t.other[0])), rest).otherwise(text), t).alias("text"))

    loss = F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"], t))
    return formatted.select("*", F.transform(zipped, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))
