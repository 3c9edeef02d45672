"""Chat formatting with DataFrame expressions only.

Rows of a conversation are collected as structs and sorted by turn; neighbouring turns of one role become one block;
blocks are concatenated as ``<turn>role<text>text<next>text</turn>``. Inside roles and texts ``\\`` is written ``\\\\``
and ``<`` is written ``<\\``, so none of the four control strings can appear there and reading back is exact.

The loss mask lists spans ``(block, start, length)``: 0-based block, 0-based code point within that block, code points.
It covers the whole body of each assistant block; ``<next>`` inside a span is a control string, not text, and unescapes
to nothing. Offsets are relative to a block, which keeps work linear in a conversation's length.

One formatted conversation is one value, so a conversation's turns meet in one row by definition; nothing else does.

Cases: null text or role counts as empty; null turns come first, equal turns are ordered by role, then text, repeated
rows all stay; rows with null conv_id form one conversation; an empty table gives an empty table; columns other than
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<turn>", "<text>", "<next>", "</turn>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    """Inverse of ``escape``; control strings left in the text vanish."""
    return F.regexp_replace(F.replace(text, F.lit(NEXT), F.lit("")), r"(<)\\|\\(\\)", "$1$2")


def format_conversations(rows: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """``(conv_id, formatted, loss_mask)``, one row per conversation."""
    turns = rows.select("conv_id", F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_turn"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    at = F.col("_turns")
    starts = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (F.get(at, i)["role"] != F.get(at, i - 1)["role"]))
    convs = convs.withColumn("_starts", starts)
    merged = F.transform("_starts", lambda s, k: F.struct(
        F.get(at, s)["role"].alias("role"),
        F.slice(at, s + 1, F.coalesce(F.get(F.col("_starts"), k + 1), F.size(at)) - s).alias("turns")))
    convs = convs.select("conv_id", F.transform(merged, lambda b: F.struct(
        (b["role"] == F.lit(loss_role)).alias("loss"),
        F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT)).alias("head"),
        F.array_join(F.transform(b["turns"], lambda t: escape(t["text"])), NEXT).alias("body"))).alias("_blocks"))
    written = F.array_join(F.transform("_blocks", lambda b: F.concat(b["head"], b["body"], F.lit(END))), "")
    mask = F.filter(F.transform("_blocks", lambda b, k: F.struct(
        k.alias("block"), F.length(b["head"]).alias("start"), F.length(b["body"]).alias("length"), b["loss"].alias("loss"))),
        lambda s: s["loss"])
    mask = F.transform(mask, lambda s: F.struct(s["block"].alias("block"), s["start"].alias("start"), s["length"].alias("length")))
    return convs.select("conv_id", written.alias("formatted"), mask.alias("loss_mask"))


def _blocks(formatted: Column) -> Column:
    pieces = F.split(formatted, END)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted conversation."""
    def block(b: Column) -> Column:
        parts = F.split(F.substring(b, len(TURN) + 1, 1 << 30), TEXT, 2)
        return F.transform(F.split(F.get(parts, F.lit(1)), NEXT), lambda t: F.struct(
            unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(_blocks(formatted), block))


def read_loss_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    blocks = _blocks(formatted)
    return F.array_join(F.transform(F.arrays_zip(
        F.transform(loss_mask, lambda s: F.get(blocks, s["block"])).alias("b"), loss_mask.alias("s")),
        lambda z: unescape(z["b"].substr(z["s"]["start"] + 1, z["s"]["length"]))), "")


def escape_sample(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant row whose text looks like control strings of chat templates."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("\\### Assistant: </turn> ok").alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation: ``n_turns``, digests, ``loss_chars``, ``formatted_chars``."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("_turns"),
                            read_loss_text(F.col("formatted"), F.col("loss_mask")).alias("_loss"))
    listed = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
