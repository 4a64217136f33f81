"""Telling our own messages from others by a bag of sent hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import WATCH_PREVIEW, full_hash, prefix

EXTERNAL, NEW = "external_message", "new_messages"


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    window = Window.partitionBy("chat_url", "hash").orderBy(order)
    return rows.withColumn("n", F.row_number().over(window))


def text_hash(text: Column) -> Column:
    """The hash a text is matched by; a missing text counts as an empty one."""
    return full_hash(F.coalesce(text, F.lit("")))


def mark_external(messages: DataFrame, sent: DataFrame, compat: bool = False, used: DataFrame | None = None) -> DataFrame:
    """``messages`` with ``external``: a user message that no text in ``sent`` (chat_url, text) accounts for.

    Every sent text accounts for one message; ``used`` (chat_url, hash, n) says
    how many of a text have done so before. Missing roles are not the user's.
    With ``compat`` the messages are cut to 500 characters before they are
    hashed while sent texts are not, so a longer one never matches.
    """
    seen = prefix(F.col("text"), WATCH_PREVIEW) if compat else F.col("text")
    by_user = F.coalesce(F.col("role") == "user", F.lit(False))
    have = sent.groupBy("chat_url", text_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("have"))
    if used is not None:
        spent = used.select("chat_url", "hash", F.col("n").alias("spent"))
        have = have.join(spent, ["chat_url", "hash"], "left").withColumn("have", F.col("have") - F.coalesce("spent", F.lit(0))).drop("spent")
    # the first messages of a text are accounted for, as many as were sent
    numbered = _numbered(messages.where(by_user).withColumn("hash", text_hash(seen)), "index")
    matched = numbered.join(have, ["chat_url", "hash"], "left").withColumn("external", F.col("n") > F.coalesce("have", F.lit(0)))
    other = messages.where(~by_user).withColumn("external", F.lit(False))
    columns = [*messages.columns, "external"]
    return matched.select(columns).unionByName(other.select(columns))


def spend(marked: DataFrame, used: DataFrame) -> DataFrame:
    """``used`` with the user's messages in ``marked`` that sent texts account for."""
    ours = marked.where(F.coalesce(F.col("role") == "user", F.lit(False)) & ~F.col("external"))
    now = ours.groupBy("chat_url", text_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"))
    return now.unionByName(used.select("chat_url", "hash", "n")).groupBy("chat_url", "hash").agg(F.sum("n").alias("n"))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left, each row of right taken away once."""
    return left.exceptAll(right)


def watch_events(marked: DataFrame, totals: DataFrame) -> DataFrame:
    """One event a chat from its new messages: type, new_count, messages in order, total_count.

    A chat's batch of new messages is one event, so it is gathered whole.
    """
    item = F.struct("index", "role", prefix(F.col("text"), WATCH_PREVIEW).alias("text"))
    batches = marked.groupBy("chat_url").agg(
        F.when(F.bool_or("external"), EXTERNAL).otherwise(NEW).alias("type"),
        F.count("*").alias("new_count"),
        F.array_sort(F.collect_list(item)).alias("messages"),
    )
    return batches.join(totals.select("chat_url", F.col("message_count").alias("total_count")), "chat_url")
