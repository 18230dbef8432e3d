"""Chat formatting in budgeted windows of whole turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What counts as a token when windows are measured.
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
#: Tokens of a window, and the share of them that repeated turns before its own may take.
BUDGET, HISTORY_TURNS, HISTORY_SHARE = 512, 2, 0.25


def escape(text: Column) -> Column:
    """Text in which no control string can occur: every ``<|`` gets one bar more."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n"), F.lit("\n")))


def windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_share: float = HISTORY_SHARE,
) -> DataFrame:
    """(conv_id, windows) with ``windows`` an array of (formatted, repeated, loss) per conversation.

    ``formatted`` is the text of a window, ``repeated`` the number of leading turns that an earlier window has
    already, ``loss`` the spans (start, length in code points) that are trained on: the text of each assistant
    turn, in the one window where it is new.

    The turns of a conversation, ordered by turn, role and text (nulls first), are cut where the prefix sum of
    their tokens passes the budget. A window begins with the conversation's leading system turn, then repeats up
    to ``history_turns`` turns that fit in ``history_share`` of the budget, both without loss. A turn is never
    cut: one larger than the budget has a window of its own. Null texts and roles are empty; repeated rows are
    turns of their own; null conv_ids form one conversation; an empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = rows.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"), F.regexp_count(t["text"], F.lit(TOKEN)).alias("n"),
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"))).alias("turns"))
    rows = rows.select("conv_id", "turns", (F.col("turns")[0]["role"] == "system").alias("led"),
                       F.transform("turns", lambda t: t["n"].cast("long")).alias("costs"))
    rows = rows.withColumn("fixed", F.when(F.col("led"), F.col("costs")[0]).otherwise(F.lit(0)))
    history = F.lit(int(budget * history_share))
    # the first window has no repeats; later ones pay for the system turn and leave room for history
    room = F.lit(budget) - F.col("fixed") - history
    cut = F.aggregate(
        F.sequence(F.lit(1), F.size("costs")),
        F.struct(F.lit(0).cast("long").alias("used"), F.array(F.lit(1)).alias("starts")),
        lambda acc, i: _cut(acc, i, F.get("costs", i - 1), budget, room),
        lambda acc: acc["starts"],
    )
    rows = rows.withColumn("starts", cut)
    spans = F.transform("starts", lambda s, k: F.struct(s.alias("first"), (F.coalesce(F.get("starts", k + 1), F.size("costs") + 1) - 1).alias("last")))
    rows = rows.withColumn("spans", spans)
    return rows.select("conv_id", F.transform("spans", lambda w: _window(w, history_turns, history)).alias("windows"))


def _cut(acc: Column, i: Column, cost: Column, budget: int, room: Column) -> Column:
    limit = F.when(F.size(acc["starts"]) == 1, F.lit(budget)).otherwise(room)
    over = (acc["used"] + cost > limit) & (i > F.element_at(acc["starts"], -1))
    return F.struct(
        F.when(over, cost).otherwise(acc["used"] + cost).alias("used"),
        F.when(over, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"),
    )


def _window(w: Column, history_turns: int, history: Column) -> Column:
    led = (F.col("led") & (w["first"] > 1)).cast("int")
    low = F.greatest(led + 1, w["first"] - history_turns)
    # the longest run of turns just before the window that fits
    fits = F.filter(
        F.sequence(F.lit(0), F.lit(history_turns)),
        lambda h: (w["first"] - h >= low)
        & (F.aggregate(F.slice("costs", F.greatest(w["first"] - h, F.lit(1)), h), F.lit(0).cast("long"), lambda a, x: a + x) <= history),
    )
    back = F.array_max(fits)
    head = F.when(led == 1, F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
    old = F.concat(head, F.slice("turns", F.greatest(w["first"] - back, F.lit(1)), back))
    new = F.slice("turns", w["first"], w["last"] - w["first"] + 1)
    render = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    before = render(old)
    mask = F.aggregate(
        new,
        F.struct(F.char_length(before).cast("long").alias("at"), F.lit(None).cast("array<struct<start:bigint,length:bigint>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + len(END) + 1).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(
                    F.coalesce(acc["loss"], F.array().cast("array<struct<start:bigint,length:bigint>>")),
                    F.array(F.struct((acc["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).cast("long").alias("length"))),
                ),
            ).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: F.coalesce(acc["loss"], F.array().cast("array<struct<start:bigint,length:bigint>>")),
    )
    return F.struct(F.concat(before, render(new)).alias("formatted"), F.size(old).alias("repeated"), mask.alias("loss"))


def parsed_turns(window: Column) -> Column:
    """The turns (role, text) of a formatted window, its repeated ones left out."""
    pieces = F.filter(F.split(window["formatted"], r"<\|im_start\|>", -1), lambda p, k: k > window["repeated"])
    return F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(_body(p)).alias("text")))


def _body(piece: Column) -> Column:
    at = F.instr(piece, "\n")
    return F.substring(piece, at + 1, F.char_length(piece) - at - len(END) - 1)


def loss_texts(window: Column) -> Column:
    """The unescaped texts under a window's loss mask."""
    return F.transform(window["loss"], lambda s: unescape(F.substring(window["formatted"], (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digest(formatted: DataFrame) -> DataFrame:
    """What the windows say when they are read back: counts and digests of turns and of trained text."""
    texts = F.array_join(F.flatten(F.transform("windows", loss_texts)), "")
    turns = F.flatten(F.transform("windows", parsed_turns))
    rows = formatted.select("conv_id", "windows", turns.alias("turns"), texts.alias("trained"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w["formatted"])).alias("formatted_chars"),
        F.size("windows").cast("long").alias("n_windows"),
    )
