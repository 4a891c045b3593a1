"""Chat formatting by a template, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from defectflow.llm.common import whole


@dataclass(frozen=True)
class ChatTemplate:
    """What is written around a turn, and which turns are trained on.

    ``opening`` must begin with ``<|`` and ``closing`` too: those two characters
    never occur in an escaped text. ``moves`` are the transitions of the role
    automaton, ``final`` the states in which a conversation may end.
    """

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    r"""``<|`` becomes ``<\|``; one backslash more if some are there already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def _unescape_role(role: Column) -> Column:
    for plain, coded in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def format_chats(
    turns: DataFrame,
    template: ChatTemplate = CHATML,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One training text per conversation, with the parts that bear loss.

    Returns ``conv_col, formatted, segments, valid, bad_turn``. ``segments`` lists
    ``(start, length, loss)`` over the code points of ``formatted``, in order and
    without gaps: an opening, a text and a closing for each turn. Texts of trained
    roles bear loss. ``valid`` says whether the role automaton accepts the order
    of turns; ``bad_turn`` counts from 0 to the first turn it has no move for
    (the number of turns, if it only ends in the wrong state).

    Offsets are running sums in a window over the turns of a conversation, which
    spills; only the finished text of one conversation is ever put together in one
    row. Null texts and roles are empty; an empty role has no move. Turns are
    ordered by turn, null first, ties by role and text; repeated rows stay. Null
    conversation ids form one conversation. An empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"),
        whole(F.col(role_col)).alias("_role"), whole(F.col(text_col)).alias("_raw"),
    )
    rows = rows.withColumns({
        "_open": F.concat(F.lit(template.opening), _escape_role(F.col("_role")), F.lit("\n")),
        "_text": escape(F.col("_raw")),
    }).withColumns({"_head": F.length("_open"), "_body": F.length("_text")})
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_raw")
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closing = len(template.closing)
    end = F.sum(F.col("_head") + F.col("_body") + F.lit(closing)).over(through)
    rows = rows.select(
        "_conv", F.row_number().over(order).alias("_n"), end.alias("_end"), "_head", "_body", "_role",
        F.concat("_open", "_text", F.lit(template.closing)).alias("_piece"),
    )
    chats = rows.groupBy("_conv").agg(F.sort_array(F.collect_list(
        F.struct("_n", "_end", "_head", "_body", "_role", "_piece")
    )).alias("_turns"))

    def parts(t):
        start = t["_end"] - t["_head"] - t["_body"] - closing

        def part(at, length, loss):
            return F.struct(at.cast("int").alias("start"), length.cast("int").alias("length"), loss.alias("loss"))

        return F.array(
            part(start, t["_head"], F.lit(False)),
            part(start + t["_head"], t["_body"], t["_role"].isin(*template.trained)),
            part(t["_end"] - closing, F.lit(closing), F.lit(False)),
        )

    moves = F.create_map(*[
        F.lit(x) for state, roles in template.moves.items() for role in roles for x in (f"{state}\n{role}", role)
    ])

    def step(state, turn):
        following = F.element_at(moves, F.concat(state["at"], F.lit("\n"), turn["_role"]))
        return F.struct(
            F.coalesce(following, F.lit("")).alias("at"),
            (state["good"] + F.coalesce((following != "").cast("int"), F.lit(0))).alias("good"),
        )

    walked = F.aggregate("_turns", F.struct(F.lit("start").alias("at"), F.lit(0).alias("good")), step)
    chats = chats.withColumn("_walk", walked)
    valid = F.col("_walk.at").isin(*template.final)
    return chats.select(
        F.col("_conv").alias(conv_col),
        F.array_join(F.transform("_turns", lambda t: t["_piece"]), "").alias("formatted"),
        F.flatten(F.transform("_turns", parts)).alias("segments"),
        valid.alias("valid"),
        F.when(~valid, F.col("_walk.good")).alias("bad_turn"),
    )


def loss_texts(formatted: Column, segments: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.transform(masked, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


def read_chats(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """The turns of a formatted text as ``array<struct<role, text>>``."""
    pieces = F.split(formatted, F.lit("\\Q" + template.opening + "\\E"), -1)

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        length = F.length(piece) - F.length(role) - 1 - len(template.closing)
        return F.struct(
            _unescape_role(role).alias("role"),
            unescape(F.substring(piece, F.length(role) + 2, length)).alias("text"),
        )

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
