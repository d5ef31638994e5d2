"""Chat formatting from a declarative template, with DataFrame functions only.

A finite-state machine over the roles validates the order of turns. Each turn becomes three segments (header, text,
end), of which the loss covers the texts of the template's loss roles. Control characters in roles and texts
are escaped, so the output can be read back whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The escape character and what it turns into come first: afterwards every backslash is followed by one of the letters.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


@dataclass(frozen=True)
class Template:
    """Headers, ends and loss roles, and the machine: (state, role) to state. Unlisted steps are invalid."""

    before: str = "### "
    after: str = ": "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def final_state(roles: Column, template: Template) -> Column:
    """The state after all roles; 'invalid' once a step is not listed."""
    keys = [F.lit(x) for (state, role), to in template.steps.items() for x in (f"{state}\0{role}", to)]
    steps = F.create_map(*keys)
    return F.aggregate(roles, F.lit(template.start), lambda state, role: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit("\0"), role)), F.lit("invalid")))


def formatted(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, segments: array<struct<text, loss>>, formatted, valid), one row for each conversation.

    Rows go by turn, then role, then text, so ties are in a fixed order; repeated rows are turns of their own. Null
    roles and texts count as empty. A null conversation id is a conversation. Conversations that the machine does not
    accept are formatted all the same and have valid false. Other columns are not read. No rows give no rows.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(F.concat(F.lit(template.before), escaped(t["role"]), F.lit(template.after)), F.lit(False)),
            segment(escaped(t["text"]), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.end), F.lit(False)),
        )

    out = convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        final_state(F.transform("turns", lambda t: t["role"]), template).isin(*template.accepting).alias("valid"),
    )
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_turns(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, unescaped."""
    turns = F.filter(F.split(text, template.end), lambda x: x != "")
    skip = len(template.before) + 1

    def turn(x: Column) -> Column:
        at = F.locate(template.after, x)
        role = F.substring(x, F.lit(skip), at - skip)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(x, at + len(template.after), F.length(x))).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return unescaped(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
