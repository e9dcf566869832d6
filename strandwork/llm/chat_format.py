"""Chat formatting with DataFrame functions only: every participant in turn becomes the assistant.

A conversation is rendered once for each participant. That speaker's messages are the assistant's, the others are named
users, roles of `context` (such as the system prompt) are nobody's perspective and keep their place. The mask holds the
spans of code points, end exclusive, that a model is trained on: the assistant's texts with their closing mark.

A conversation is rendered whole. Where some are too long for a row, `span` cuts them into parts of so many turn numbers
(turn 0 to span - 1, and so on), so that no row and no group grows with the conversation; the parts of a conversation and
speaker, joined in order, are the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTEXT = ("system",)
UNNAMED = "unknown"


def _segment(m: Column, speaker: Column, context: tuple[str, ...]) -> Column:
    """struct<head, body> of one message: what comes before the text, and the text with its mark."""
    who = F.when(m["role"].isin(*context), m["role"]).when(m["role"] == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), m["role"]))
    return F.struct(F.concat(F.lit(OPEN), who, F.lit("\n")).alias("head"), F.concat(m["text"], F.lit(CLOSE)).alias("body"), (m["role"] == speaker).alias("own"))


def _mask(segments: Column) -> Column:
    """array<struct<start,end>> of the speaker's own bodies."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        out = F.when(s["own"], F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct((end + 1).alias("at"), out.alias("out"))

    return F.aggregate(segments, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", context: tuple[str, ...] = CONTEXT, span: int | None = None) -> DataFrame:
    """(conv_id, speaker, part, n_messages, rendered, mask) for every participant and part of every conversation.

    Messages come by turn; those that share a turn by role, then text; rows that agree in all four are as many messages.
    Messages without a turn come first, or with `span` form a part of their own (part null). Without `span` part is 0. A null role is the speaker "unknown", a null
    text is empty, and rows without conv_id are one conversation without a name. A conversation that holds context
    only has no participant and no row; very long texts stay whole. Only the named columns are read; empty tables give an empty result.
    """
    own = turns.select(
        F.col(conv_id).alias("conv_id"),
        (F.floor(F.col(turn) / span) if span else F.lit(0)).cast("bigint").alias("part"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(UNNAMED)).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    parts = own.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    speakers = own.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")).distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv")))
    segments = F.transform("messages", lambda m: _segment(m, F.col("speaker"), context))
    rendered = F.concat(F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "\n"), F.lit("\n"))
    return both.select("conv_id", "speaker", "part", segments.alias("segments")).select("conv_id", "speaker", "part", F.size("segments").cast("bigint").alias("n_messages"), rendered.alias("rendered"), _mask(F.col("segments")).alias("mask"))


def mask_text(mask: Column) -> Column:
    """start:end of each span, comma-joined."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
