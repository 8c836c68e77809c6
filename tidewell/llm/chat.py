"""Dialogues of several speakers, rendered once per speaker with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import numbered
from tidewell.session import written

START, END = "<|im_start|>", "<|im_end|>"


def _plain(c: Column) -> Column:
    """Text without control marks of its own."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    turns_per_block: int = 512,
) -> DataFrame:
    """One row per conversation, perspective and block: ``text`` and the spans of it to train on, ``mask``.

    Every role but ``system`` is a participant and gets its perspective: its turns come from the assistant,
    system turns stay, all others come from a user with the role as name. ``mask`` holds [start, end) in
    code points: content and end mark of the assistant's turns. A conversation without participants has one
    perspective, null, with nothing to train on. Turns stand in the order (turn, role, text), nulls first.
    Repeated rows of a turn are one turn: ``n_rows`` counts the rows, ``n_turns`` the turns. A null role is
    a user without name, a null text empty; a null conversation is one of its own. A long conversation gives
    several blocks of ``turns_per_block`` turns by their place in this order, whatever their numbers; no task
    holds more than one block of a conversation. Extra columns take no part and are not returned. An empty
    table gives no rows.
    """
    t = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )

    speakers = t.select("conv_id", F.when(F.col("role") != "system", F.col("role")).alias("perspective")).distinct()
    alone = speakers.groupBy("conv_id").agg(F.max("perspective").alias("any")).withColumnRenamed("conv_id", "c")
    perspectives = written(
        speakers.join(alone, F.col("conv_id").eqNullSafe(F.col("c")))
        .where("perspective IS NOT NULL OR any IS NULL")
        .select(F.col("conv_id").alias("c"), "perspective"),
        "perspectives",
    )

    def head(said: Column) -> Column:
        return F.concat(F.lit(START), said, F.lit("\n"))

    name = F.regexp_replace(_plain(F.col("role")), r"[ \t\n\x0B\f\r]", "_")
    user = F.when(F.col("role").isNull(), F.lit("user")).otherwise(F.concat(F.lit("user name="), name))
    other = head(F.when(F.col("role") == "system", F.lit("system")).otherwise(user))
    assistant = head(F.lit("assistant"))

    def before(length: Column, *within: str) -> Column:
        w = Window.partitionBy("conv_id", "block", *within).orderBy("turn", "role", "text")
        return F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    body = F.concat(_plain(F.col("text")), F.lit(END))
    # a turn starts after all before it as others see them, but the speaker's own ones have another head
    distinct = t.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    parts = (
        numbered(distinct, "conv_id", ["turn", "role", "text"])
        .withColumn("block", F.expr(f"position div {turns_per_block}"))
        .withColumns({"other": other, "body": body})
        .withColumn("seen", before(F.char_length("other") + F.char_length("body") + 1))
        .withColumn("start", F.col("seen") + before(F.char_length(assistant) - F.char_length("other"), "role"))
    )
    part = F.struct("turn", "role", "text", "other", "body", "start")
    blocks = parts.groupBy("conv_id", "block").agg(
        F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(part)).alias("turns")
    )
    each = blocks.join(perspectives, F.col("conv_id").eqNullSafe(F.col("c")))

    def own(x: Column) -> Column:
        return F.coalesce(x["role"] == F.col("perspective"), F.lit(False))

    def shown(x: Column) -> Column:
        return F.concat(F.when(own(x), assistant).otherwise(x["other"]), x["body"], F.lit("\n"))

    def span(x: Column) -> Column:
        start = (x["start"] + F.char_length(assistant)).cast("int")
        return F.struct(start.alias("start"), (start + F.char_length(x["body"])).alias("end"))

    return each.select(
        "conv_id",
        "perspective",
        "block",
        F.size("turns").cast("long").alias("n_turns"),
        "n_rows",
        F.array_join(F.transform("turns", shown), "").alias("text"),
        F.transform(F.filter("turns", own), span).alias("mask"),
    )
