"""Trigger words in messages: classification, events, deduplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOTICE_PREVIEW, PREVIEW, UNTITLED, form_encode, is_blank, key, or_default, prefix, short_hash

CALL, REPLY = "architect_call", "architect_reply"


# The trigger's stem, the form of a reply, how many keys are remembered, and the text of a notice.
STEM, REPLY_FORM = "архитектор", r"^\s*\[?\s*[Яя]\s+[Аа]рхитектор\s*\]?"
CAP = 5000
NOTICE = "🔔 GPT → Архитектор\n[%s] в чате «%s»\nmsg#%s: %s"


@dataclass(frozen=True)
class Patterns:
    """A call is a word that starts with the stem, in any case; a reply is at the start of any line."""

    stem: str = STEM
    reply: str = REPLY_FORM

    def is_call(self, text: Column) -> Column:
        return text.rlike(rf"(?iuU)\b{self.stem}\w*")

    def is_reply(self, text: Column) -> Column:
        return text.rlike(f"(?mdU){self.reply}")


def classify(messages: DataFrame, patterns: Patterns) -> DataFrame:
    """User messages with a trigger, and its kind as ``type``: a reply goes before a call."""
    text = F.col("text")
    kind = F.when(patterns.is_reply(text), REPLY).when(patterns.is_call(text), CALL)
    spoken = messages.where((F.col("role") == "user") & ~is_blank(text))
    return spoken.withColumn("type", kind).where("type IS NOT NULL")


def events(messages: DataFrame, patterns: Patterns, project: str = "", states: DataFrame | None = None) -> DataFrame:
    """Events of triggered messages; titles and projects come from ``states`` (url, title, project) where known."""
    found = classify(messages, patterns)
    if states is None:
        found = found.withColumns({"project": F.lit(project), "chat_title": F.lit("")})
    else:
        named = states.select(F.col("url").alias("chat_url"), "project", F.col("title").alias("chat_title"))
        found = found.join(named, "chat_url", "left")
    return found.select(
        "type",
        or_default(F.col("project"), project).alias("project"),
        F.coalesce("chat_title", F.lit("")).alias("chat_title"),
        "chat_url",
        F.col("index").alias("message_index"),
        "role",
        prefix(F.col("text"), PREVIEW).alias("text_preview"),
        short_hash(F.col("text")).alias("message_hash"),
    )


def event_key() -> Column:
    return key(F.col("chat_url"), F.col("message_index"), F.col("message_hash"))


def unprocessed(found: DataFrame, processed: DataFrame) -> DataFrame:
    """Events whose key is not among ``processed`` (key)."""
    return found.withColumn("key", event_key()).join(processed, "key", "left_anti")


def remember(processed: DataFrame, found: DataFrame) -> DataFrame:
    """The processed keys with those of new events."""
    return processed.select("key").union(found.select(event_key().alias("key"))).distinct()


def cap(keys: DataFrame, n: int = CAP) -> DataFrame:
    """The n keys seen last, of (key, first_seen); ties go to the smaller key."""
    return keys.orderBy(F.col("first_seen").desc(), "key").limit(n)


def notices(found: DataFrame, chat: str = "") -> DataFrame:
    """Texts to send for calls: a title and a short preview, and the same as a web form."""
    title = or_default(F.col("chat_title"), UNTITLED)
    preview = prefix(F.col("text_preview"), NOTICE_PREVIEW)
    text = F.format_string(NOTICE, "type", title, "message_index", preview)
    return found.where(F.col("type") == CALL).select(
        "chat_url", "message_index", text.alias("text"), form_encode({"chat_id": F.lit(chat), "text": text}).alias("payload")
    )
