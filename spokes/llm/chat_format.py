"""Chat formatting by prefix-target expansion (native DataFrame functions only).

A conversation is the rows of one ``conv_id`` by ``turn``. Each assistant turn
becomes one example: all turns before it are context, and only its own text is
under the loss mask. Turns after the last reply, and conversations without a
reply, end in one more example with an empty mask, so no turn is lost.

Template of a turn: ``<turn ROLE>\\nTEXT</turn>\\n``. In roles and texts ``&``,
``<`` and ``>`` are written ``&a``, ``&l`` and ``&g``; so no text can hold a
marker, and undoing them in the order ``&l``, ``&g``, ``&a`` gives the text back.

Defined cases: null text or role: empty string; null turn: before the others;
equal turns: by role, then text; repeated rows: each is a turn; null conv_id: one
conversation of its own; empty table: no rows; other columns are ignored. A
conversation is one unit, like a document: its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template and the escapes, in the order in which they are applied.
OPEN, OPEN_END, CLOSE = "<turn ", ">\n", "</turn>\n"
ESCAPES = (("&", "&a"), ("<", "&l"), (">", "&g"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """Rows: conv_id, n_turns (context and target), text, loss_start, loss_length (code points), is_last."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                t.role.alias("role"),
                F.concat(F.lit(OPEN), escape(t.role), F.lit(OPEN_END)).alias("head"),
                escape(t.text).alias("body"),
            ),
        ).alias("turns"),
    ).select(
        "conv_id",
        "turns",
        F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))).alias("segments"),
        F.size("turns").alias("total"),
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.col("total")),
        lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == F.col("total")),
    )
    at = parts.select("conv_id", "turns", "segments", "total", F.explode(ends).alias("n"))
    target = F.element_at("turns", F.col("n"))
    context = F.when(F.col("n") > 1, F.array_join(F.slice("segments", 1, F.col("n") - 1), "")).otherwise("")
    reply = target["role"] == "assistant"
    return at.select(
        "conv_id",
        F.col("n").cast("long").alias("n_turns"),
        context.alias("context"),
        F.element_at("segments", F.col("n")).alias("segment"),
        F.when(reply, F.length(target["head"])).otherwise(0).alias("skip"),
        F.when(reply, F.length(target["body"])).otherwise(0).alias("loss_length"),
        (F.col("n") == F.col("total")).alias("is_last"),
    ).select(
        "conv_id",
        "n_turns",
        F.concat("context", "segment").alias("text"),
        (F.length("context") + F.col("skip")).cast("long").alias("loss_start"),
        F.col("loss_length").cast("long").alias("loss_length"),
        "is_last",
    )


def parse(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    whole = F.filter(F.split(text, CLOSE), lambda s: s != "")
    return F.transform(
        whole,
        lambda s: F.struct(
            unescape(F.substring_index(F.substring(s, len(OPEN) + 1, 2**30), OPEN_END, 1)).alias("role"),
            unescape(F.substring_index(s, OPEN_END, -1)).alias("text"),
        ),
    )


def loss_text(text: Column, start: Column, length: Column) -> Column:
    return unescape(F.substring(text, (start + 1).cast("int"), length.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from formatted examples alone: counts and hashes of turns and of what is under the mask."""
    read = examples.select(
        "conv_id",
        "n_turns",
        F.length("text").alias("chars"),
        F.when(F.col("is_last"), parse(F.col("text"))).alias("turns"),
        loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
    ).select(
        "conv_id",
        "n_turns",
        "chars",
        "loss",
        F.size("turns").alias("total"),
        F.when(
            F.col("turns").isNotNull(),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256),
        ).alias("turns_sha256"),
    )
    return (
        read.groupBy("conv_id")
        .agg(
            F.max("total").cast("long").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            F.sort_array(F.collect_list(F.struct("n_turns", "loss"))).alias("losses"),
            F.sum("chars").cast("long").alias("formatted_chars"),
        )
        .withColumn("all_loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("all_loss").cast("long").alias("loss_chars"),
            F.sha2("all_loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
