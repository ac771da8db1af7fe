"""Dialogues seen by each speaker: the speaker is the assistant, all others are named users.

For every participant of a conversation (every role except `system`) each turn is rendered once:
own turns as the assistant, turns of others as users with their names, system turns as they are.
`start` and `end` are the turn's characters in that whole rendering, and the mask covers
the text and closing mark of own turns. One row per turn and perspective, so a
conversation of any length is never gathered.

Running lengths are added up in blocks of BLOCK turns and then over blocks. Texts are shuffled once,
to meet the places that slim rows have worked out.

Everything is DataFrame functions. Defined results: a null text is empty; a null role is the user
`unknown` to everyone and no participant; a null turn comes before all others, as turn -1; rows
without conv_id are left out; repeated rows are one turn; several rows of one turn
stand in the order of role and text hash; marks inside a text are broken up by a space; a conversation
without participants has no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylag.llm.keys import col

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"


def _safe(text: Column) -> Column:
    """Text in which no control mark can begin."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _header() -> Column:
    speaker = F.coalesce("role", F.lit(UNKNOWN))
    name = (
        F.when(F.col("role") == SYSTEM, F.lit(SYSTEM))
        .when(F.col("role") == F.col("perspective"), F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), _safe(speaker)))
    )
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """One row per conversation, perspective and turn: rendering, place, and mask."""
    turns = conversations.where(col("conv_id").isNotNull()).select(
        col("conv_id").alias("conv_id"),
        F.coalesce(col("turn"), F.lit(-1)).cast("long").alias("turn"),
        col("role").alias("role"),
        col("text").alias("text"),
        F.sha2(F.concat_ws(":", F.coalesce(col("role"), F.lit(UNKNOWN)), F.coalesce(col("text"), F.lit(""))), 256).alias("key"),
    )
    slim = turns.select("conv_id", "turn", "role", "key", F.char_length(_safe(F.col("text"))).cast("long").alias("length")).distinct()
    people = slim.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    views = slim.join(people, "conv_id").withColumns(
        {"block": F.floor(F.col("turn") / BLOCK), "header": F.char_length(_header()).cast("long")}
    )
    views = views.withColumn("size", F.col("header") + F.col("length") + len(CLOSE) + 1)
    view = "conv_id", "perspective"
    inside = Window.partitionBy(*view, "block").orderBy("turn", "role", "key")
    before = Window.partitionBy(*view).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = views.groupBy(*view, "block").agg(F.sum("size").alias("total"))
    blocks = blocks.select(*view, "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("prior"))
    placed = views.withColumn("run", F.sum("size").over(inside)).join(blocks, [*view, "block"])
    texts = turns.groupBy("conv_id", "turn", "key").agg(F.first("text").alias("text"))
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    end = F.col("prior") + F.col("run")
    full = placed.withColumns({"end": end, "start": end - F.col("size")}).join(texts, ["conv_id", "turn", "key"])
    return full.select(
        *view,
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.concat(_header(), _safe(F.col("text")), F.lit(CLOSE + "\n")).alias("rendered"),
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        F.when(own, F.col("start") + F.col("header")).cast("long").alias("mask_start"),
        F.when(own, F.col("end") - 1).cast("long").alias("mask_end"),
    )
