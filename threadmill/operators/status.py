"""One-row and one-label summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN_ROLE, or_default

# Why a chat is not brought up to date, the first reason that holds.
REASONS = ("not_on_chat", "generating", "composer_has_text", "composer_has_attachments")


def sync_reason(states: DataFrame, chat: str = "/c/") -> DataFrame:
    """url, ok and reason of (url, generating, composer_text, has_attachments); nulls hold nothing back."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    tests = (
        ~yes(F.contains("url", F.lit(chat))),
        yes(F.col("generating")),
        yes(F.col("composer_text").rlike(r"(?U)\S")),
        yes(F.col("has_attachments")),
    )
    reason = F.lit(None).cast("string")
    for test, name in reversed(tuple(zip(tests, REASONS, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    return states.select("url", reason.alias("reason")).select("url", F.col("reason").isNull().alias("ok"), "reason")


def roles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("role", or_default(F.col("role"), UNKNOWN_ROLE))


def health(ready: Column) -> Column:
    return F.when(F.coalesce(ready, F.lit(False)), "ready").otherwise("login_required")


# What a monitor looks at.
MODES = ("active_only", "project_recent", "global_recent")


def in_mode(messages: DataFrame, mode: str, active: str, recent: DataFrame | None = None) -> DataFrame:
    """Messages that a monitor looks at: of the active chat alone, or also of those in ``recent`` (chat_url)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    looked = messages.where(F.col("chat_url") == active)
    if mode == "active_only" or recent is None:
        return looked
    others = recent.select("chat_url").where(F.col("chat_url") != active).distinct()
    return looked.unionByName(messages.join(others, "chat_url", "left_semi"))


def every(active: Column, other: Column) -> Column:
    """How many looks at the active chat go to one look at the others."""
    return F.greatest(F.lit(1), F.floor(other / active)).cast("long")


def full(states: DataFrame, events: DataFrame, keys: DataFrame, scans: DataFrame, now: float) -> DataFrame:
    """All of a monitor's status as one row.

    ``scans`` has one row a look: looked_at, mode, running, active_chat_url, triggers
    and error. The last look gives what holds now, the first one when it
    started; without any the monitor is not running and its uptime is zero.
    """
    last = lambda c: F.max_by(c, "looked_at").alias(c)
    failed = F.when(F.col("error").isNotNull(), F.col("looked_at"))
    looks = scans.agg(
        F.coalesce(F.max_by("running", "looked_at"), F.lit(False)).alias("running"),
        last("mode"),
        F.min("looked_at").alias("started_at"),
        F.coalesce((F.lit(now) - F.min("looked_at")).cast("long"), F.lit(0)).alias("uptime_sec"),
        F.count("*").alias("scan_count"),
        F.coalesce(F.sum("triggers"), F.lit(0)).alias("trigger_count"),
        last("active_chat_url"),
        F.max_by("error", failed).alias("last_error"),
        F.max(failed).alias("last_error_at"),
        F.max(F.when(F.col("error").isNull(), F.col("looked_at"))).alias("last_sync_at"),
    )
    return with_sizes(looks, states, events, keys)


def with_sizes(looks: DataFrame, states: DataFrame, events: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of what was looked at, with tracked_chats, pending_events and processed_dedup_keys."""
    counts = monitor(states, events, keys, 0.0, 0.0).select("tracked_chats", "pending_events", F.col("dedup_keys").alias("processed_dedup_keys"))
    return looks.crossJoin(counts)  # single rows


def monitor(states: DataFrame, events: DataFrame, keys: DataFrame, started: float, now: float) -> DataFrame:
    """tracked_chats, pending_events, dedup_keys and uptime_seconds (cut to an integer) as one row."""
    counted = states.agg(F.countDistinct("chat_url").alias("tracked_chats"))
    counted = counted.crossJoin(events.agg(F.count("*").alias("pending_events")))  # single rows
    counted = counted.crossJoin(keys.agg(F.countDistinct("key").alias("dedup_keys")))
    return counted.withColumn("uptime_seconds", F.lit(now - started).cast("long"))
