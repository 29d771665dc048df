"""Chat formatting by prefix-target expansion, in built-in expressions only.

Every assistant turn becomes an example of its own: its context is all turns
before it, and only its reply is trainable.  Contexts of one conversation are
prefixes of the same formatted stream, so the stream is stored once, a row per
turn, and an example holds where its context ends and its loss span lies in
it; text grows with the turns and not with their square.  ``render_examples``
spells examples out for a trainer.

Template of a turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  In role and text
``&`` is written ``&amp;`` and ``<|`` is written ``&lt;|`` (and a line feed in a
role ``&#10;``), so no content can look like a mark and every string comes back.

Edge cases: null text or role is empty; a null turn sorts first; a null
conversation id is a conversation; rows with an equal turn are ordered by role
and text; repeated rows stay; empty tables give empty tables.  Columns other
than the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The formatted streams: ``conv_id, n, role, segment, seg_start, body_start, body_end, seg_end``.

    ``n`` counts the turns of a conversation from 0; the offsets are code points
    in its stream, the concatenation of its segments in the order of ``n``.
    """
    said = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    cut = said.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    cut = cut.withColumn("segment", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn("n", F.row_number().over(order) - 1).withColumn(
        "seg_end", F.sum(F.length("segment").cast("long")).over(upto)
    )
    seg_start = F.col("seg_end") - F.length("segment")
    body_start = seg_start + F.length("head")
    return placed.select(
        "conv_id", "n", "role", "segment",
        seg_start.alias("seg_start"), body_start.alias("body_start"), (body_start + F.length("body")).alias("body_end"), "seg_end",
    )


def expand_targets(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One example for each assistant turn: ``conv_id, target, context_turns, context_end, loss_start, loss_end``.

    The example's text is the stream up to ``loss_end``: the turns before
    ``target`` (``context_turns`` of them, to ``context_end``) and the reply,
    whose span ``[loss_start, loss_end)`` alone is trained.
    """
    return turns.filter(F.col("role") == trainable).select(
        "conv_id",
        F.col("n").alias("target"),
        F.col("n").alias("context_turns"),
        F.col("seg_start").alias("context_end"),
        F.col("body_start").alias("loss_start"),
        F.col("body_end").alias("loss_end"),
    )


def render_examples(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples spelt out: ``conv_id, target, prompt, reply``; ``prompt`` ends where the reply is to start.

    The output is as large as the sum of all prefixes, so render what a trainer is about to read.
    """
    t, e = turns.alias("t"), examples.alias("e")
    parts = e.join(t, F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("t.n") <= F.col("e.target")))
    joined = parts.groupBy("e.conv_id", "e.target", "e.loss_start", "e.loss_end").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t.n", "t.segment"))), lambda x: x["segment"]), "").alias("stream")
    )
    return joined.select(
        "conv_id", "target",
        F.expr("substring(stream, 1, int(loss_start))").alias("prompt"),
        F.expr("substring(stream, int(loss_start) + 1, int(loss_end - loss_start))").alias("reply"),
    )


def parse_segment(segment: Column) -> tuple[Column, Column]:
    """Role and text out of a formatted turn."""
    inner = F.substring(segment, F.lit(len(OPEN) + 1), F.length(segment) - F.lit(len(OPEN) + len(CLOSE)))
    at = F.instr(inner, F.lit("\n"))
    role = unescaped(F.replace(F.substring(inner, F.lit(1), at - 1), F.lit("&#10;"), F.lit("\n")))
    return role, unescaped(F.substring(inner, at + 1, F.length(inner)))


def digest_conversations(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """Digests of what the output holds, a row per conversation, from parsed segments and loss spans.

    A digest of a conversation is a hash over its whole text in order, so its
    turns meet in one row here; formatting itself needs no such gathering.
    """
    role, text = parse_segment(F.col("t.segment"))
    spans = examples.select(F.col("conv_id"), F.col("target").alias("n"), "loss_start", "loss_end")
    t, e = turns.alias("t"), spans.alias("e")
    read = t.join(e, F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("t.n") == F.col("e.n")), "left").select(
        F.col("t.conv_id").alias("conv_id"),
        F.col("t.n").alias("n"),
        F.length("t.segment").cast("long").alias("chars"),
        F.concat(role, F.lit("\n"), text, F.lit("\n")).alias("said"),
        F.when(
            F.col("e.n").isNotNull(),
            unescaped(F.expr("substring(t.segment, int(e.loss_start - t.seg_start) + 1, int(e.loss_end - e.loss_start))")),
        ).otherwise(F.lit("")).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("n", "said", "loss"))).alias("parts"),
    )
    said = F.array_join(F.transform("parts", lambda x: x["said"]), "")
    loss = F.array_join(F.transform("parts", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
