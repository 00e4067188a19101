"""Chat formatting: role state machine and declarative template; DataFrame functions only.

``TEMPLATE`` says how a role's turn opens, how turns end and which roles carry
loss.  ``MACHINE`` says which role may follow in which state.  A conversation
becomes one text and the list of its segments (text, loss); ``read_back`` takes
the text apart again.

Control strings inside texts are escaped with a backslash placed inside them,
and backslashes are doubled, so a text never holds a control string as it is
and undoing the escapes gives the text back exactly.  Role names outside the
template are escaped alike, a last ``#`` included.

Defined results: null text is empty; null roles are read back as empty roles;
roles that the template doesn't know open with their escaped name; turns are
ordered by turn (null first), ties by role and text, and repeated rows are
turns of their own; rows of null conv_id form one conversation; conversations
that the machine rejects are formatted too, and flagged.  A conversation is one
value of its result and so bounded as any text value is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightwords.llm.common import pick

TEMPLATE = {
    "open": {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    "other": ("### Role ", " ### "),  # around the name of any other role
    "end": "</turn>\n",
    "loss": ("assistant",),
}
#: State and role -> next state.  A conversation may end in the states of FINAL.
MACHINE = {
    ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
    ("asked", "assistant"): "answered", ("answered", "user"): "asked",
}
FINAL = ("answered",)
#: Strings that mark turns, each with its escaped form; backslashes come first.
ESCAPES = (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("### ", "#\\## "))
UNESCAPE = r"\\([\\/#])"


def escape(text: Column) -> Column:
    return reduce(lambda s, pair: F.replace(s, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1")


def opening(role: Column, template=TEMPLATE) -> Column:
    before, after = template["other"]
    # a name that ends in # must not run into what follows it
    name = F.regexp_replace(escape(role), r"#\z", r"\\#")
    other = F.concat(F.lit(before), name, F.lit(after))
    return reduce(lambda c, item: F.when(role == item[0], F.lit(item[1])).otherwise(c), template["open"].items(), other)


def final_state(roles: Column, machine=MACHINE) -> Column:
    """The state after all roles; 'rejected' from the first forbidden one on."""
    step = F.create_map(*[F.lit(x) for (state, role), to in machine.items() for x in (f"{state}>{role}", to)])
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(step, F.concat_ws(">", s, r)), F.lit("rejected")))


def format_chats(rows: DataFrame, template=TEMPLATE, machine=MACHINE) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, state, valid."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = pick(rows, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def emitted(t: Column) -> Column:
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(opening(t["role"], template), F.lit(False)),
            segment(escape(t["text"]), t["role"].isin(*template["loss"])),
            segment(F.lit(template["end"]), F.lit(False)),
        )

    segments = F.flatten(F.transform("turns", emitted))
    chats = chats.select("conv_id", segments.alias("segments"), final_state(F.transform("turns", lambda t: t["role"]), machine).alias("state"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return chats.select("conv_id", formatted.alias("formatted"), "segments", "state", F.col("state").isin(*FINAL).alias("valid"))


def read_back(formatted: Column, template=TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted text."""
    end = template["end"]
    pieces = F.split(formatted, r"\Q" + end + r"\E")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # nothing follows the last end
    before, after = template["other"]

    def parsed(piece: Column) -> Column:
        named = F.substr(piece, F.lit(len(before) + 1))
        at = F.locate(after, named)
        role = unescape(F.substr(named, F.lit(1), at - 1))
        text = F.substr(named, at + len(after))
        for name, start in template["open"].items():
            own = F.startswith(piece, F.lit(start))
            role = F.when(own, F.lit(name)).otherwise(role)
            text = F.when(own, F.substr(piece, F.lit(len(start) + 1))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, parsed)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
