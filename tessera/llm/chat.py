"""Chat formatting with a role automaton and loss flags (operator 7, DataFrame functions only).

A template declares the markup of a turn, the roles whose text bears loss and the legal role
order.  A conversation becomes a list of segments (text, loss flag); their concatenation is
the training text.  Texts are escaped so that no control string can occur in them: the
characters that open a control string, and the escape sign, are replaced by two-character
codes that hold neither.  Reading back splits at the control strings and undoes the codes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markup around role and text, what bears loss, and the role automaton.

    ``transitions`` maps (state, role) to the next state; states in ``accepting`` may end a
    conversation.  Roles are their own states, ``start`` is the initial one.
    """

    open: str = "### "
    colon: str = ":\n"
    close: str = "\n</turn>\n"
    #: Escape codes, the escape sign first.  Each control string must hold one of the others
    #: in its markup, except ``colon``, which is found only in the role part.
    codes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    })
    accepting: tuple[str, ...] = ("user", "assistant")


def escape(text: Column, template: Template) -> Column:
    for char, code in template.codes:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, template: Template) -> Column:
    for char, code in reversed(template.codes):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _escape_role(role: Column, template: Template) -> Column:
    """Roles are short names; a line break in one would hide the colon, so it gets a code too."""
    return F.replace(escape(role, template), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column, template: Template) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")), template)


def format_conversations(turns: DataFrame, template: Template = Template(),
                         by: Sequence[str] = ("conv_id",)) -> DataFrame:
    """One row per conversation: ``segments``, ``formatted``, ``valid`` and ``final_state``.

    Turns are ordered by turn, then role and text, nulls first; repeated rows are all kept.
    Null roles and texts count as empty.  A conversation in an order that the automaton
    refuses is formatted all the same and marked as not valid; its final state is null.
    Other columns of the input are left out.
    """
    by = list(by)
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy(*by).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    steps = F.map_from_arrays(
        F.array(*[F.lit(f"{a}\n{b}") for a, b in template.transitions]),
        F.array(*[F.lit(s) for s in template.transitions.values()]))
    final = F.aggregate(
        F.transform("turns", lambda t: t["role"]), F.lit("start"),
        lambda state, role: F.try_element_at(steps, F.concat_ws("\n", F.coalesce(state, F.lit("")), role)))

    def parts(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        return F.array(
            F.struct(F.concat(F.lit(template.open), _escape_role(t["role"], template),
                              F.lit(template.colon)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")))

    out = grouped.select(*by, F.flatten(F.transform("turns", parts)).alias("segments"),
                         final.alias("final_state"))
    return out.select(
        *by, "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        F.coalesce(F.col("final_state").isin(*template.accepting), F.lit(False)).alias("valid"),
        "final_state")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Roles and texts of a formatted conversation, as an array of structs."""
    # Every turn ends with the closing string, so the last piece is empty.
    pieces = F.split(formatted, "\\Q" + template.close + "\\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(template.open) + 1, 2**31 - 1)
        at = F.instr(body, template.colon)
        return F.struct(
            _unescape_role(F.substring(body, F.lit(1), at - 1), template).alias("role"),
            unescape(F.substring(body, at + len(template.colon), F.lit(2**31 - 1)), template)
            .alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.concat_ws("", F.transform(kept, lambda s: unescape(s["text"], template)))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation the digests of what is read back from the formatted output."""
    out = format_conversations(turns)
    back = out.select("conv_id", "formatted", "valid", read_turns(F.col("formatted")).alias("turns"),
                      loss_text(F.col("segments")).alias("loss"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")
