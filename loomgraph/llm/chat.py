"""Chat formatting in budgeted windows.

Turns are counted in words. Prefix sums of the turns before each turn, divided by a stride, choose the window whose
target the turn is, so windows hold whole turns. The stride is half of what the budget leaves beside the longest
system turn, and a turn longer than the stride has a window of its own, so the system turn and a window's own turns
stay within the budget unless a single turn and the system turn are too long together. Before its own turns a
window repeats the system turn in force, and of the last few turns as many as the budget still allows; the loss mask
covers only the assistant turns that are its own.

Template: ``<turn ROLE>TEXT</turn>\\n`` with both parts escaped: a backslash becomes ``\\0``, ``<`` becomes ``\\1``,
``>`` becomes ``\\2``. In escaped text every backslash starts such a code and no angle bracket is left, so a
control string inside a text can't end a turn, and ``unescape`` restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import word_count

#: Words of a window: system turn, history and own turns.
BUDGET = 512
#: Turns before a window's own that it repeats at most.
HISTORY = 2

OPEN, MIDDLE, CLOSE = "<turn ", ">", "</turn>\n"
#: Order matters on the way back: the backslash last.
CODES = (("<", "\\1"), (">", "\\2"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for raw, code in CODES:
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for raw, code in CODES:
        out = F.replace(out, F.lit(code), F.lit(raw))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of each conversation: ``conv_id, window, formatted, n_words, n_repeated, loss_spans``.

    ``turns`` has conv_id, turn, role, text. ``n_repeated`` turns stand before a window's own ones: the last system
    turn before them, if any, and then up to ``history`` turns from just before, dropped from the earliest on until
    the window is within ``budget`` words (``n_words``). Only where a turn and the longest system turn
    exceed the budget together, their window does; nothing is cut.
    ``loss_spans`` are (start, end) in code points of ``formatted``, end exclusive, around the escaped texts of
    the window's own assistant turns.

    Null texts and roles count as empty strings. Rows with a null conv_id form one conversation. Turns are
    ordered by turn (null first), then role and text; equal rows stay turns of their own. An empty table
    gives no windows. Other columns are ignored. All turns of a conversation are ordered in one task.
    """
    clean = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    counted = clean.select("*", (F.col("role") == "system").alias("system"), word_count(F.col("text")).alias("n"))
    conversation = Window.partitionBy("conv_id")
    ordered = conversation.orderBy("turn", "role", "text")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    own_system = F.when(F.col("system"), F.col("n"))
    placed = counted.select(
        "*",
        F.row_number().over(ordered).alias("at"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.last(own_system, ignorenulls=True).over(earlier), F.lit(0)).alias("in_force"),
        F.greatest(F.lit(1), F.floor((budget - F.coalesce(F.max(own_system).over(conversation), F.lit(0))) / 2)).alias("stride"),
    )
    placed = placed.withColumn("long", (F.col("n") > F.col("stride")).cast("int"))
    by_place = conversation.orderBy("at")
    stretch = 2 * F.coalesce(F.sum("long").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("long")
    placed = placed.withColumn("stretch", stretch).withColumn("band", F.floor(F.col("before") / F.col("stride")))
    placed = placed.withColumn("window", F.dense_rank().over(conversation.orderBy("stretch", "band")) - 1)
    in_window = Window.partitionBy("conv_id", "window").orderBy("at")
    placed = placed.select(
        "*",
        F.first("before").over(in_window).alias("begin"),
        (budget - F.first("in_force").over(in_window) - F.sum("n").over(Window.partitionBy("conv_id", "window"))).alias("room"),
    )
    ahead = [F.lead(F.struct("window", "begin", "room"), k).over(by_place) for k in range(1, history + 1)]
    next_system = F.first(F.when(F.col("system"), F.col("window")), ignorenulls=True)
    no_windows = F.array().cast("array<int>")
    later = placed.select(
        "*",
        (F.array(*ahead) if ahead else F.array().cast("array<struct<window:int,begin:bigint,room:bigint>>")).alias("ahead"),
        F.coalesce(next_system.over(by_place.rowsBetween(1, Window.unboundedFollowing)), F.max("window").over(conversation)).alias("until"),
    )
    fits = F.filter("ahead", lambda w: (w["window"] > F.col("window")) & (w["begin"] - F.col("before") <= w["room"]))
    repeats = (
        F.when(~F.col("system"), F.array_distinct(F.transform(fits, lambda w: w["window"])))
        .when(F.col("until") > F.col("window"), F.sequence(F.col("window") + 1, F.col("until")))
        .otherwise(no_windows)
    )
    own = F.array(F.struct(F.col("window"), F.lit(True).alias("own")))
    again = F.transform(repeats, lambda w: F.struct(w.alias("window"), F.lit(False).alias("own")))
    member = later.select("conv_id", "at", "n", "role", "text", "system", F.explode(F.concat(own, again)).alias("m"))
    body = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE))
    member = member.select("conv_id", "at", "n", "role", "system", F.col("m.window").alias("window"), F.col("m.own").alias("own"), body.alias("body"))
    # the repeated system turn, repeated history, then the own turns in order
    rank = F.struct("own", (F.col("own") | ~F.col("system")).alias("plain"), "at")
    ends = F.sum(F.length("body")).over(Window.partitionBy("conv_id", "window").orderBy(rank))
    learn = F.col("own") & (F.col("role") == "assistant")
    span = F.struct((F.col("end") - F.length("body") + F.length(escape(F.col("role"))) + len(OPEN) + len(MIDDLE)).cast("int").alias("start"), (F.col("end") - len(CLOSE)).cast("int").alias("end"))
    member = member.withColumn("end", ends)
    windows = member.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "body"))).alias("pieces"),
        F.sum("n").alias("n_words"),
        F.sum((~F.col("own")).cast("int")).cast("int").alias("n_repeated"),
        F.sort_array(F.collect_list(F.when(learn, span))).alias("loss_spans"),
    )
    return windows.select("conv_id", "window", F.array_join(F.transform("pieces", lambda p: p["body"]), "").alias("formatted"), "n_words", "n_repeated", "loss_spans")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that ``formatted`` holds, unescaped."""
    parts = F.filter(F.split(formatted, r"</turn>\n"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(x, MIDDLE, -1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss mask, nothing between the spans."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
