"""Chat formatting by a declarative template and a finite-state machine over roles; DataFrame functions only.

Every turn becomes three segments: its opening (turn mark, role, body mark), its text, and its closing. Only the text of
a role in ``loss_roles`` carries the loss flag. The marks all begin with ``<|``. In texts and roles each ``<|`` gets a
backslash more between ``<`` and ``|`` than it had, so no text can contain a mark, and taking one away restores it.

Defined cases: a null text or role is empty; turns are ordered by (turn, role, text), nulls first, so repeated turns have
one order; rows without conv_id form one conversation of null id; an empty table gives no row; columns other than
conv_id, turn, role and text are ignored. A conversation is one value (its digests need its whole text), so its rows meet
in one row of the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The machine's state after a turn that it rejects.
REJECTED = ""


@dataclass(frozen=True)
class ChatTemplate:
    """What a format looks like. ``transitions`` maps (state, role) to the next state; a pair that is missing is an error."""

    turn_mark: str = "<|turn|>"
    body_mark: str = "<|body|>"
    end_mark: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def __post_init__(self) -> None:
        marks = (self.turn_mark, self.body_mark, self.end_mark)
        if len({*marks}) < 3 or not all(m.startswith("<|") and m.endswith("|>") and "<|" not in m[2:] for m in marks):
            raise ValueError("marks must differ, begin with <| and end with |>")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", "<$1|")


def _literal(text: str) -> str:
    return "".join("\\" + x if not x.isalnum() else x for x in text)


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, valid (the turn order is one that the machine accepts) and
    bad_turn (from 0, the position of the first turn that it rejects, else null)."""
    t = template
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    steps = [x for (state, role), to in t.transitions.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))]
    machine = F.create_map(*steps) if steps else F.create_map().cast("map<string,string>")
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))).alias("turns"))
    turns = turns.withColumn("turns", F.transform("turns", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))))
    piece = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                piece(F.concat(F.lit(t.turn_mark), escape(x["role"]), F.lit(t.body_mark)), F.lit(False)),
                piece(escape(x["text"]), x["role"].isin(*t.loss_roles) if t.loss_roles else F.lit(False)),
                piece(F.lit(t.end_mark + "\n"), F.lit(False)),
            ),
        )
    )
    first = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        to = F.coalesce(F.try_element_at(machine, F.concat(acc["state"], F.lit("\n"), x["role"])), F.lit(REJECTED))
        return F.when(acc["state"] == REJECTED, acc).otherwise(F.struct(to.alias("state"), (acc["seen"] + (to != REJECTED).cast("int")).alias("seen")))

    run = F.aggregate("turns", first, step)
    out = turns.select("conv_id", segments.alias("segments"), run.alias("run"))
    return out.select(
        "conv_id",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        "segments",
        (F.col("run.state") != REJECTED).alias("valid"),
        F.when(F.col("run.state") == REJECTED, F.col("run.seen")).alias("bad_turn"),
    )


def read_chat(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns, array<struct<role, text>>, of a formatted conversation."""
    t = template
    parts = F.split(formatted, _literal(t.turn_mark))
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, t.body_mark, 1)
        body = F.substring_index(F.substr(x, F.length(role) + len(t.body_mark) + 1), t.end_mark, 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def digest(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """What the formatted output holds, read back from it: digests of all turns and of all text under the loss mask."""
    back = chats.select("conv_id", "formatted", "valid", read_chat(F.col("formatted"), template).alias("turns"), F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
