"""Chat formatting from a declarative template, with a finite-state machine over roles.

The template names the marks around a turn, the roles under the loss and the allowed order of
roles. Control strings inside a text are escaped by a backslash that the reader takes off again,
so a text can neither open nor close a turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``start`` role ``after_role`` text ``end`` for each turn; ``start`` and ``end`` begin with ``<|``.

    ``order`` maps a state (a role, or "start") to the roles that may follow; ``final`` are the roles
    that may end a conversation.
    """

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    """Every ``<|`` of the text, with any backslashes between, gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """(conv_id, n_turns, valid, bad_turn, segments, formatted, loss_spans) for each conversation.

    ``turns``: conv_id, turn, role, text; other columns are ignored. Rows go by turn, then role and
    text, nulls first; a null text or role is empty; rows that repeat are turns of their own; a null
    conv_id is a conversation. ``segments`` are (role, text, loss) pieces that make up ``formatted``;
    ``loss_spans`` are (start from 1, length) in code points of the pieces under the loss. ``valid``
    tells if the roles follow the template's order, ``bad_turn`` is the first that doesn't (from 0, or
    the number of turns if the conversation ends too early). A conversation is one row, so its turns
    meet in one task by intent; conversations spread by id.
    """
    said = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = turns.select("conv_id", said.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    allowed = F.create_map(*(x for state, roles in template.order.items() for x in (F.lit(state), F.array(*map(F.lit, roles)).cast("array<string>"))))
    begin = F.struct(F.lit("start").alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("i"))

    def step(at: Column, turn: Column) -> Column:
        fits = F.coalesce(F.array_contains(F.try_element_at(allowed, at["state"]), turn["role"]), F.lit(False))
        return F.struct(turn["role"].alias("state"), F.when((at["bad"] >= 0) | fits, at["bad"]).otherwise(at["i"]).alias("bad"), (at["i"] + 1).alias("i"))

    def pieces(turn: Column) -> Column:
        plain = lambda text: F.struct(turn["role"].alias("role"), text.alias("text"), F.lit(False).alias("loss"))
        body = F.struct(turn["role"].alias("role"), escape(turn["text"]).alias("text"), turn["role"].isin(*template.loss_roles).alias("loss"))
        return F.array(plain(F.concat(F.lit(template.start), _escape_role(turn["role"]), F.lit(template.after_role))), body, plain(F.lit(template.end)))

    chats = chats.withColumn("walk", F.aggregate("turns", begin, step)).withColumn("segments", F.flatten(F.transform("turns", pieces)))
    bad = F.when(F.col("walk.bad") >= 0, F.col("walk.bad")).when(~F.col("walk.state").isin(*template.final), F.col("walk.i"))
    none = F.struct(F.lit(1).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start: bigint, length: bigint>>)").alias("spans"))

    def place(acc: Column, piece: Column) -> Column:
        size = F.length(piece["text"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), size.alias("length")))
        return F.struct((acc["at"] + size).alias("at"), F.when(piece["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("segments", none, place)["spans"]
    formatted = F.concat_ws("", F.transform("segments", lambda s: s["text"]))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), bad.isNull().alias("valid"), bad.alias("bad_turn"), "segments", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """(conv_id, turns, loss_text) read back from ``formatted`` and ``loss_spans`` alone: turns are (role, text)."""

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, template.after_role)
        body = F.substring(piece, cut + len(template.after_role), F.length(piece) - cut + 1 - len(template.after_role) - len(template.end))
        return F.struct(_unescape_role(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    quoted = "".join(f"\\{c}" if c in r"<>|\^$.()[]{}*+?" else c for c in template.start)
    parts = F.split("formatted", quoted)
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))))
    return chats.select("conv_id", F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_digests(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Digests of every conversation, all read back from the formatted text and its loss mask."""
    back = read_chats(format_chats(turns, template), template)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
