"""Chat formatting (operator 2), in DataFrame functions only.

A template declares the marks around a turn, the roles that carry loss and the turn order as a finite-state machine.
Formatting a conversation emits its text, its segments with loss flags, and whether the machine accepts its roles;
reading parses a formatted text back to turns.  Inside roles and texts a control string's opening `<|` gets a
backslash (`<|` -> `<\\|`, `<\\|` -> `<\\\\|`, ...), which reading removes, so texts that hold marks come back whole.

A conversation is one row of the result, as its digest needs its turns in order; its turns are gathered in one task.
Cases: a null text is empty, a null role is an empty one; turns are ordered by turn (nulls first), then role, then
text, so ties have one order; rows that repeat are turns of their own; a null conversation id is a conversation;
an empty table gives an empty result.  Columns beyond conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """The marks must begin with `<|`; transitions: state -> role -> next state."""

    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple = ("assistant",)
    start: str = "start"
    accepting: tuple = ("user", "assistant")
    transitions: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", r"<$1|")


def escape_role(x: Column) -> Column:
    """As escape(); a line feed, which would end the role, becomes `<|n|>` first, one that is there already differs by its backslash."""
    return F.regexp_replace(escape(x), "\n", "<|n|>")


def unescape_role(x: Column) -> Column:
    return unescape(F.regexp_replace(x, r"<\|n\|>", "\n"))


def accepts(roles: Column, t: ChatTemplate = ChatTemplate()) -> Column:
    """Whether the machine ends in an accepting state; an undeclared step leads to a dead state."""
    table = F.create_map(*[F.lit(x) for s, row in t.transitions.items() for r, to in row.items() for x in (f"{s} {r}", to)])
    step = lambda s, r: F.coalesce(F.try_element_at(table, F.concat_ws(" ", s, r)), F.lit("dead"))
    return F.aggregate(roles, F.lit(t.start), step).isin(*t.accepting)


def segments(turns: Column, t: ChatTemplate = ChatTemplate()) -> Column:
    """Three segments for each turn: opening marks, text, closing marks; loss is on for the texts of loss roles."""
    off = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))
    one = lambda x: F.array(
        off(F.concat(F.lit(t.turn_start), escape_role(x["role"]), F.lit(t.role_end))),
        F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
        off(F.lit(t.turn_end + t.after_turn)),
    )
    return F.flatten(F.transform(turns, one))


def format_chats(rows: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, segments, formatted, valid: a row for each conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = turns.select("conv_id", segments(F.col("turns"), t).alias("segments"), accepts(F.col("turns.role"), t).alias("valid"))
    return out.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), "valid")


def read_chat(formatted: Column, t: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) of a formatted text."""
    quoted = "".join(f"\\{c}" if c in "|<>[](){}.*+?^$\\" else c for c in t.turn_start)
    end = len(t.turn_end + t.after_turn)

    def one(piece: Column) -> Column:
        role = F.substring_index(piece, t.role_end, 1)
        skip = F.length(role) + len(t.role_end)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(piece, skip + 1, F.length(piece) - skip - end)).alias("text"))

    pieces = F.split(formatted, quoted)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)


def loss_text(turns: Column, segs: Column) -> Column:
    """All text under the loss mask, as read back from the formatted text: turn k's text is segment 3 k + 1."""
    masked = F.filter(turns, lambda x, k: F.get(segs, 3 * k + 1)["loss"])
    return F.array_join(F.transform(masked, lambda x: x["text"]), "")


def chat_digests(rows: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """What reading the formatted conversations gives back, as counts and digests."""
    out = format_chats(rows, t).withColumn("turns", read_chat(F.col("formatted"), t))
    out = out.withColumn("loss", loss_text(F.col("turns"), F.col("segments")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
