"""State documents in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "struct<title:string,project:string,last_seen_count:bigint,last_checked_at:double>"


def chat_states(documents: DataFrame, column: str = "document", known: DataFrame | None = None) -> DataFrame:
    """One row a chat from documents {states: {url: {...}}}; missing fields are empty or zero.

    Rows of ``known`` (the same columns) stay for urls that the documents lack.
    """
    parsed = F.from_json(column, f"struct<states:map<string,{STATE}>,updated_at:double>")
    rows = documents.select(F.explode(parsed["states"]).alias("url", "s")).select(
        "url",
        F.coalesce("s.title", F.lit("")).alias("title"),
        F.coalesce("s.project", F.lit("")).alias("project"),
        F.coalesce("s.last_seen_count", F.lit(0)).cast("long").alias("last_seen_count"),
        F.coalesce("s.last_checked_at", F.lit(0.0)).alias("last_checked_at"),
    )
    return rows if known is None else rows.unionByName(known.join(rows, "url", "left_anti"))


def dedup_keys(documents: DataFrame, column: str = "document") -> DataFrame:
    """The distinct keys of documents {keys: [...]}; they replace what was known."""
    parsed = F.from_json(column, "struct<keys:array<string>,updated_at:double>")
    return documents.select(F.explode(parsed["keys"]).alias("key")).distinct()


def states_document(states: DataFrame) -> DataFrame:
    """The states as one map in a single JSON document: a snapshot of a bounded set of chats."""
    entry = F.struct(F.col("url"), F.struct("title", "project", "last_seen_count", "last_checked_at"))
    return states.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("states"))).alias("document"))
