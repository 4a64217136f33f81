"""Scans of ordered message sequences.

A message is (chat_url, index, role, text); the index is the place in its chat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import UNKNOWN_ROLE, or_default

SCHEMA = "chat_url string, index long, role string, text string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_conversations(conversations: DataFrame) -> DataFrame:
    """The conversations table as messages; a missing role is unknown."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("chat_url"),
        F.col("turn").cast("long").alias("index"),
        or_default(F.col("role"), UNKNOWN_ROLE).alias("role"),
        "text",
    )


def load(spark: SparkSession, folder: str) -> DataFrame:
    return from_conversations(table(spark, folder, "conversations"))


def from_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Messages from JSON lines; a line that cannot be read is skipped, not fatal."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("role", or_default(F.col("role"), UNKNOWN_ROLE))


def land(messages: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """Write messages as table ``name``, in buckets by chat and sorted by place, and return the table.

    Counts, tails, marks and joins by chat read it without a shuffle, and a range
    of places skips what lies outside it. A bucket is one file.
    """
    dealt = messages.repartition(buckets, "chat_url")
    dealt.write.mode("overwrite").bucketBy(buckets, "chat_url").sortBy("chat_url", "index").saveAsTable(name)
    return messages.sparkSession.table(name)


def between(messages: DataFrame, start: int, end: int) -> DataFrame:
    """The half-open range [start, end) of each chat."""
    return messages.where((F.col("index") >= start) & (F.col("index") < end))


def since(messages: DataFrame, after: int) -> DataFrame:
    return messages.where(F.col("index") > after)


def last(messages: DataFrame, n: int, partition: str = "chat_url") -> DataFrame:
    """The last n messages of each chat; none if n is zero or less."""
    order = Window.partitionBy(partition).orderBy(F.col("index").desc())
    return messages.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def tail(messages: DataFrame, n: int = 20) -> DataFrame:
    """As ``last``, but a number of zero or less asks for all messages."""
    return last(messages, n) if n > 0 else messages


def counts(messages: DataFrame) -> DataFrame:
    """chat_url, message_count and assistant_count."""
    return messages.groupBy("chat_url").agg(
        F.count("*").alias("message_count"), F.count_if(F.col("role") == "assistant").alias("assistant_count")
    )
