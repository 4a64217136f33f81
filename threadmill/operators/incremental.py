"""What is new since a stored mark, under two different policies.

``states`` has chat_url and last_seen_count; a chat without a row is met for
the first time. Counts and marks are small next to the messages, so they are
joined first and bound the read. ``known`` has counts (chat_url, message_count)
that are kept up elsewhere; without them messages are scanned once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.messages import counts

TAIL = 5


def _marked(messages: DataFrame, states: DataFrame, known: DataFrame | None) -> DataFrame:
    seen = states.select("chat_url", F.col("last_seen_count").alias("seen"))
    return (counts(messages) if known is None else known).select("chat_url", "message_count").join(seen, "chat_url", "left")


def _range(messages: DataFrame, bounds: DataFrame) -> DataFrame:
    """Messages with start <= index < end of their chat."""
    inside = (F.col("index") >= F.col("start")) & (F.col("index") < F.col("end"))
    return messages.join(bounds.select("chat_url", "start", "end"), "chat_url").where(inside).drop("start", "end")


def monotone(messages: DataFrame, states: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Everything from the mark on; the mark never falls."""
    grown = _marked(messages, states, known).where(F.col("message_count") > F.col("seen"))
    return _range(messages, grown.withColumns({"start": F.col("seen"), "end": F.col("message_count")}))


def bounded(messages: DataFrame, states: DataFrame, tail: int = TAIL, known: DataFrame | None = None) -> DataFrame:
    """From the mark on, but at most ``tail`` messages: of more new ones the older are not read."""
    changed = _marked(messages, states, known).where(F.col("message_count") != F.col("seen"))
    start = F.greatest("seen", F.col("message_count") - tail)
    return _range(messages, changed.withColumns({"start": start, "end": F.col("message_count")}))


def first_met(messages: DataFrame, states: DataFrame, tail: int = TAIL, known: DataFrame | None = None) -> DataFrame:
    """The last messages of chats without a state."""
    new = _marked(messages, states, known).where("seen IS NULL")
    start = F.greatest(F.lit(0), F.col("message_count") - tail)
    return _range(messages, new.withColumns({"start": start, "end": F.col("message_count")}))


def missed(messages: DataFrame, states: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """After a restart: all messages from a stored mark above zero on."""
    behind = _marked(messages, states, known).where((F.col("seen") > 0) & (F.col("message_count") > F.col("seen")))
    return _range(messages, behind.withColumns({"start": F.col("seen"), "end": F.col("message_count")}))


def marks(messages: DataFrame, states: DataFrame, falling: bool = False, known: DataFrame | None = None) -> DataFrame:
    """The next marks: the larger of mark and count, or the count itself if marks may fall."""
    joined = _marked(messages, states, known)
    mark = F.col("message_count") if falling else F.greatest(F.coalesce("seen", F.lit(0)), "message_count")
    return joined.select("chat_url", mark.cast("long").alias("last_seen_count"))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after and new of (chat_url, message_count) on two occasions; new may be negative."""
    return (
        before.select("chat_url", F.col("message_count").alias("before"))
        .join(after.select("chat_url", F.col("message_count").alias("after")), "chat_url", "full_outer")
        .select(
            "chat_url",
            F.coalesce("before", F.lit(0)).alias("before"),
            F.coalesce("after", F.lit(0)).alias("after"),
        )
        .withColumn("new", F.col("after") - F.col("before"))
    )


def others(messages: DataFrame, active: str) -> DataFrame:
    """Messages of all chats but the active one."""
    return messages.where(F.col("chat_url") != active)


def last_hashes(messages: DataFrame, hashed) -> DataFrame:
    """chat_url and the hash of its last message."""
    return messages.groupBy("chat_url").agg(F.max_by(hashed(F.col("text")), "index").alias("last_message_hash"))
