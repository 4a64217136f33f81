"""Structured Streaming over landed messages.

Messages land as JSON lines (``sources.messages.SCHEMA``). Progress, the keys
already handled and the marks of chats live in the checkpoint, so a restart
goes on where the last run stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.text import UNKNOWN_ROLE, or_default
from ..operators import triggers
from ..operators.stability import MAX_WAIT_MS, STABLE_POLLS
from ..sources import messages
from . import state

# Seconds between looks at the active chat, and at the others as asked for; messages read of a chat at first sight.
ACTIVE_SECONDS, OTHER_SECONDS, FIRST_SIGHT = 3, 8, 5


def landed(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the JSON lines in a folder; lines that cannot be read are skipped."""
    reader = spark.readStream.schema(messages.SCHEMA).option("mode", "DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).withColumn("role", or_default(F.col("role"), UNKNOWN_ROLE))


def trigger_stream(
    stream: DataFrame,
    patterns: triggers.Patterns,
    project: str = "",
    cap: int | None = triggers.CAP,
    buckets: int = 1,
    ttl_seconds: int | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Events of triggered messages, each key once among the ``cap`` seen last, whatever is delivered again.

    Only triggers are remembered; ``state.recent_once`` says how, and what
    ``buckets``, ``ttl_seconds`` and ``known`` do. Without a cap every key is
    kept (``state.once``).
    """
    found = triggers.events(stream, patterns, project).withColumn("key", triggers.event_key())
    if cap is None:
        if ttl_seconds is not None:
            raise ValueError("without a cap no key is forgotten")
        return state.once(found, known)
    return state.recent_once(found, cap, buckets, ttl_seconds, known)


def append_json(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """An append-only log of JSON lines; the file sink and the checkpoint make each row land once."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")


def run_once(writer: DataStreamWriter) -> None:
    """All that has landed so far, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def pause(active: bool = True, active_seconds: int = ACTIVE_SECONDS, other_seconds: int = OTHER_SECONDS) -> int:
    """Seconds between two looks; other chats are looked at on a whole number of looks at the active one."""
    return active_seconds if active else active_seconds * max(1, other_seconds // active_seconds)


def keep_running(writer: DataStreamWriter, active: bool = True, active_seconds: int = ACTIVE_SECONDS, other_seconds: int = OTHER_SECONDS) -> StreamingQuery:
    """Start looking again and again, until ``stop``."""
    return writer.trigger(processingTime=f"{pause(active, active_seconds, other_seconds)} seconds").start()


def stop(query: StreamingQuery) -> str:
    """End a running query and say whether it ran; its checkpoint stays, so that the next start goes on there."""
    if not query.isActive:
        return "not_running"
    query.stop()
    return "stopped"


def new_messages(stream: DataFrame, tail: int | None = None, first: int | None = FIRST_SIGHT) -> DataFrame:
    """Messages at or beyond the mark of their chat, which is kept as state.

    Of a chat that has no mark yet the last ``first`` messages are read, all of
    them if it is null. Without ``tail`` the mark never falls and nothing new is
    lost. With it only the last ``tail`` messages of a batch are read and the
    mark is set to the batch's count, even downwards.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("index", kind="stable")
        count = int(rows["index"].max()) + 1
        seen = state.get[0] if state.exists else 0 if first is None else max(0, count - first)
        start = seen if tail is None else max(seen, count - tail)
        state.update((max(seen, count) if tail is None else count,))
        yield rows[rows["index"] >= start]

    return stream.groupBy("chat_url").applyInPandasWithState(step, messages.SCHEMA, "seen long", "append", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, sent: DataFrame, folder: str, checkpoint: str, compat: bool = False) -> DataStreamWriter:
    """One event a chat and batch, told apart by the texts in ``sent``, which may arrive while the query runs.

    ``state.watched`` says how. Events are written under the number of their
    batch, so a batch that is run again overwrites its own.
    """
    return logged(state.watched(stream, sent, compat=compat), folder, checkpoint)


def logged(events: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Rows as JSON lines in a folder for each batch; a batch that is run again overwrites its own."""

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(log).option("checkpointLocation", checkpoint)


def snapshot(marks: DataFrame, folder: str, number: int) -> str:
    """Write a snapshot of states or keys to a folder of its own, and return the folder."""
    path = f"{folder}/snapshot={number}"
    marks.write.mode("overwrite").json(path)
    return path


def latest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The snapshot of the largest number."""
    found = spark.read.schema(f"{schema}, snapshot long").json(folder)
    return found.where(F.col("snapshot") == (found.agg(F.max("snapshot")).first()[0])).drop("snapshot")


def read_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of a known schema, wanted partition columns among it; a folder that is empty or not there has no rows."""
    try:
        return spark.read.schema(schema).json(folder).select(StructType.fromDDL(schema).names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def drain(spark: SparkSession, folder: str, after: int = -1, schema: str = state.EVENT) -> tuple[DataFrame, int]:
    """Events of batches beyond ``after``, and the last batch read: reading takes nothing away."""
    events = read_json(spark, folder, f"{schema}, batch long").where(F.col("batch") > after)
    last = events.agg(F.max("batch")).first()[0]
    return events, after if last is None else int(last)


CURSOR = "upto long"


class Consumer:
    """Takes each event of a folder once, whatever other consumers take.

    What is taken is written to ``out`` first, under the last batch it holds, and
    then the cursor moves. A crash between the two leaves rows that no cursor
    names: they are read again and written anew, and ``taken`` never shows them.
    """

    def __init__(self, spark: SparkSession, folder: str, out: str, schema: str = state.EVENT):
        self.spark, self.folder, self.out, self.schema = spark, folder, out, schema

    def cursors(self) -> DataFrame:
        return read_json(self.spark, f"{self.out}/cursors", CURSOR)

    def cursor(self) -> int:
        last = self.cursors().agg(F.max("upto")).first()[0]
        return -1 if last is None else int(last)

    def write(self) -> int | None:
        """Write what is new and return the batch it goes up to, null if nothing is."""
        before = self.cursor()
        events, last = drain(self.spark, self.folder, before, self.schema)
        if last == before:
            return None
        # a batch that lands meanwhile waits for the next time
        events.where(F.col("batch") <= last).write.mode("overwrite").json(f"{self.out}/events/upto={last}")
        return last

    def commit(self, last: int) -> None:
        self.spark.createDataFrame([(last,)], CURSOR).coalesce(1).write.mode("append").json(f"{self.out}/cursors")

    def take(self) -> int | None:
        last = self.write()
        if last is not None:
            self.commit(last)
        return last

    def taken(self) -> DataFrame:
        events = read_json(self.spark, f"{self.out}/events", f"{self.schema}, batch long, upto long")
        return events.join(self.cursors().distinct(), "upto", "left_semi")


OUT = ["key", "status", "response", "poll_no"]
STABLE = "key string, status string, response string, poll_no long"


def stable_responses(polls: DataFrame, stable: int = STABLE_POLLS, longest: int = MAX_WAIT_MS, clock: bool = True) -> DataFrame:
    """The streaming form of ``stability.outcomes``: polls of a key come in order over batches, an outcome goes out once.

    A key that is not polled any more ends by the clock: what is left of its
    longest wait after its last poll. A key's state goes as long again after its outcome.
    Without ``clock`` polls alone end a key and states stay, as ``run_once`` needs: a
    stream that waits for a clock never comes to an end.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, text, repeats, shown, last = state.get if state.exists else (False, "", 0, None, 0)
        out, left = None, longest
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame([(key[0], "timeout_empty" if shown is None else "timeout_partial", shown or "", last)], columns=OUT)
            return
        for p in pd.concat(list(batches)).sort_values("poll_no").itertuples():
            if done:
                break
            there = p.assistant_count > p.pre_count
            shown, last, left = (p.text or "") if there else None, int(p.poll_no), longest - p.elapsed_ms
            if not p.generating and there:
                repeats = repeats + 1 if shown == text and shown else 0
                text = shown
                if shown and repeats >= stable:
                    out, done = ("complete", shown, last), True
            if not done and p.elapsed_ms > longest:
                out, done = ("timeout_empty" if shown is None else "timeout_partial", shown or "", last), True
        state.update((done, text, repeats, shown, last))
        if clock:
            state.setTimeoutDuration(int(longest if done else max(1, left)))
        if out is not None:
            yield pd.DataFrame([(key[0], *out)], columns=OUT)

    kept = "done boolean, text string, repeats long, shown string, last long"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if clock else GroupStateTimeout.NoTimeout
    return polls.groupBy("key").applyInPandasWithState(step, STABLE, kept, "append", timeout)
