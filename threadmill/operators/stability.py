"""When a text that is polled has come to rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Polls that must repeat a text, and the longest wait.
STABLE_POLLS, MAX_WAIT_MS = 2, 300_000


def outcomes(polls: DataFrame, stable: int = STABLE_POLLS, longest: int = MAX_WAIT_MS) -> DataFrame:
    """key, status, response and poll_no of the poll that decides.

    ``polls`` has key, poll_no, elapsed_ms, generating, assistant_count,
    pre_count and text. Polls that are generating, or show no new message, are
    passed over without breaking a run. A non-empty text that ``stable`` further
    polls repeat is complete; the first poll past the longest wait gives its
    text as partial if a new message is there, or nothing. A key that neither ends has no row.
    """
    order = Window.partitionBy("key").orderBy("poll_no")
    counted = polls.where(~F.col("generating") & (F.col("assistant_count") > F.col("pre_count")))
    text = F.coalesce("text", F.lit(""))
    turned = counted.withColumn("text", text).withColumn("turn", (F.lag("text").over(order).isNull() | (F.lag("text").over(order) != F.col("text"))).cast("int"))
    runs = turned.withColumn("run", F.sum("turn").over(order))
    within = Window.partitionBy("key", "run").orderBy("poll_no")
    settled = runs.withColumn("repeats", F.row_number().over(within) - 1).where((F.col("repeats") >= stable) & (F.col("text") != ""))
    done = settled.groupBy("key").agg(F.min_by(F.struct("poll_no", "text"), "poll_no").alias("done"))
    shown = F.when(F.col("assistant_count") > F.col("pre_count"), text)
    late = (
        polls.where(F.col("elapsed_ms") > longest)
        .groupBy("key")
        .agg(F.min_by(F.struct("poll_no", shown.alias("text")), "poll_no").alias("late"))
    )
    joined = done.join(late, "key", "full_outer")
    # rest is looked for before the clock, so a poll that is both is complete
    first = F.col("done").isNotNull() & (F.col("late").isNull() | (F.col("done.poll_no") <= F.col("late.poll_no")))
    return joined.select(
        "key",
        F.when(first, "complete").when(F.col("late.text").isNotNull(), "timeout_partial").otherwise("timeout_empty").alias("status"),
        F.when(first, F.col("done.text")).otherwise(F.coalesce("late.text", F.lit(""))).alias("response"),
        F.when(first, F.col("done.poll_no")).otherwise(F.col("late.poll_no")).alias("poll_no"),
    )
