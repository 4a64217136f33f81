"""Streams that keep keyed state: marks, sent texts, keys already handled.

State lives in the checkpoint, entry by entry, so nothing is rewritten whole. It
can be read from there while the query runs, and a new query can begin with it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import WATCH_PREVIEW
from ..operators import external, throttle
from ..sources import messages

MARK = "last_seen_count long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Let the session's new queries keep state entry by entry, which these operators need; a query that is restarted keeps its own."""
    if not spark.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


class _Marks(StatefulProcessor):
    def __init__(self, tail: int | None, first: int | None):
        self.tail, self.first = tail, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", MARK)

    def handleInitialState(self, key: tuple[Any, ...], initialState: pd.DataFrame, timerValues: Any) -> None:
        mark = int(initialState["last_seen_count"].max())
        if mark > 0:  # a mark of zero is none
            self.seen.update((max(mark, self.seen.get()[0] if self.seen.exists() else 0),))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("index", kind="stable")
        count = int(found["index"].max()) + 1
        seen = self.seen.get()[0] if self.seen.exists() else 0 if self.first is None else max(0, count - self.first)
        start = seen if self.tail is None else max(seen, count - self.tail)
        self.seen.update((max(seen, count) if self.tail is None else count,))
        yield found[found["index"] >= start]


def resumed_messages(stream: DataFrame, marks: DataFrame, tail: int | None = None, first: int | None = 5) -> DataFrame:
    """``monitor.new_messages`` of a new checkpoint that begins with stored marks (chat_url, last_seen_count).

    A chat with a mark above zero gives all its messages from the mark on, of
    whatever number; others are met for the first time. Of several marks of a
    chat the largest counts. Marks are taken over once, when the checkpoint is
    made.
    """
    prepare(stream.sparkSession)
    known = marks.select(F.col("chat_url").cast("string").alias("chat_url"), F.col("last_seen_count").cast("long").alias("last_seen_count"))
    known = known.where("chat_url IS NOT NULL AND last_seen_count IS NOT NULL").groupBy("chat_url")
    keyed = stream.select("chat_url", "index", "role", "text").groupBy("chat_url")
    return keyed.transformWithStateInPandas(_Marks(tail, first), messages.SCHEMA, "Append", "None", initialState=known)


class _Recent(StatefulProcessor):
    """Keys seen last, a bounded number of them, each with when it was seen."""

    def __init__(self, cap: int, ttl_ms: int | None):
        self.cap, self.ttl_ms = cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("keys", "key string", "stamp long", self.ttl_ms)
        self.clock = handle.getValueState("clock", "stamp long")

    def handleInitialState(self, key: tuple[Any, ...], initialState: pd.DataFrame, timerValues: Any) -> None:
        # the order they were stored in, those without one first
        newest = initialState.sort_values(["first_seen", "key"], na_position="first")["key"].tolist()[-self.cap :]
        for k, name in enumerate(newest):
            self.keys.updateValue((name,), (k,))
        self.clock.update((len(newest),))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # no more than the cap, so it is read whole, in the order of last sight, and written by entry
        held = dict(sorted(((k[0], v[0]) for k, v in self.keys.iterator()), key=lambda x: x[1]))
        before, now = set(held), self.clock.get()[0] if self.clock.exists() else 0
        touched: set[str] = set()
        for some in rows:
            some = some.sort_values(["chat_url", "message_index"], kind="stable")
            fresh = []
            for name in some["key"]:
                fresh.append(name not in held)
                held.pop(name, None)
                held[name] = now
                touched.add(name)
                now += 1
                if len(held) > self.cap:
                    del held[next(iter(held))]
            yield some[fresh].drop(columns=["bucket"])
        for name in before - held.keys():
            self.keys.removeKey((name,))
        for name in touched & held.keys():
            self.keys.updateValue((name,), (held[name],))
        self.clock.update((now,))


def recent_once(events: DataFrame, cap: int, buckets: int = 1, ttl_seconds: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rows of a stream whose key is not among those seen last, in bounded memory.

    At most ``cap`` keys are kept, in as many buckets by a hash of the key as run
    at the same time; of each the ones seen longest ago go first, and all that
    were not seen for ``ttl_seconds``. A key that has gone counts as new again.
    ``known`` (key, first_seen) is what a new checkpoint begins with.
    """
    if cap < buckets:
        raise ValueError("each bucket needs room for a key")
    prepare(events.sparkSession)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    initial = None if known is None else known.where("key IS NOT NULL").groupBy("key").agg(F.max("first_seen").cast("double").alias("first_seen")).withColumn("bucket", bucket).groupBy("bucket")
    processor = _Recent(cap // buckets, None if ttl_seconds is None else 1000 * ttl_seconds)
    rows = events.where("key IS NOT NULL").select("*", bucket)
    mode = "None" if ttl_seconds is None else "ProcessingTime"
    return rows.groupBy("bucket").transformWithStateInPandas(processor, events.schema, "Append", mode, initialState=initial)


def once(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of a stream whose key was never seen before: every key is kept, each as an entry of its own, so state grows with them.

    Keys of ``known`` (key) count as seen; the table is looked up again in each batch.
    """
    prepare(events.sparkSession)
    rows = events.where("key IS NOT NULL")
    if known is not None:
        rows = rows.join(known.where("key IS NOT NULL").select("key").distinct(), "key", "left_anti").select(events.columns)
    return rows.dropDuplicates(["key"])


EVENT = "chat_url string, type string, new_count long, messages array<struct<index:long,role:string,text:string>>, total_count long"


def _hash(text: str | None) -> str:
    return hashlib.sha1((text or "").encode("utf-8", "replace")).hexdigest()


class _Watch(StatefulProcessor):
    """A chat's mark, and how often each text was sent and not yet seen."""

    def __init__(self, first: int | None, compat: bool):
        self.first, self.compat = first, compat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", MARK)
        self.bag = handle.getMapState("bag", "hash string", "n long")

    def _add(self, name: str, n: int) -> None:
        self.bag.updateValue((name,), ((self.bag.getValue((name,))[0] if self.bag.containsKey((name,)) else 0) + n,))

    def handleInitialState(self, key: tuple[Any, ...], initialState: pd.DataFrame, timerValues: Any) -> None:
        for name, n in zip(initialState["hash"], initialState["n"], strict=True):
            self._add(name, int(n))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        places: dict[int, tuple[str, str]] = {}
        mark = self.mark.get()[0] if self.mark.exists() else None
        for some in rows:
            sent = some["index"].isna()
            # what is sent and seen in one batch was sent before
            for name, n in Counter(map(_hash, some.loc[sent, "text"])).items():
                self._add(name, n)
            for place, role, text in some.loc[~sent, ["index", "role", "text"]].itertuples(index=False, name=None):
                # of several rows of one place the least
                said = (role or "", text or "")
                if mark is None or place >= mark:
                    places[int(place)] = min(said, places.get(int(place), said))
        if not places:
            return
        count = max(places) + 1
        if mark is None and self.first is not None:
            places = {k: v for k, v in places.items() if k >= count - self.first}
        ours: dict[str, int] = {}
        outside = False
        for place in sorted(places):
            role, text = places[place]
            if role != "user":
                continue
            name = _hash(text[:WATCH_PREVIEW] if self.compat else text)
            if name not in ours:
                ours[name] = self.bag.getValue((name,))[0] if self.bag.containsKey((name,)) else 0
            outside |= ours[name] < 1
            if ours[name] > 0:
                ours[name] -= 1
                if ours[name]:
                    self.bag.updateValue((name,), (ours[name],))
                else:
                    self.bag.removeKey((name,))
        self.mark.update((count,))
        if places:
            told = [{"index": k, "role": places[k][0], "text": places[k][1][:WATCH_PREVIEW]} for k in sorted(places)]
            kind = external.EXTERNAL if outside else external.NEW
            yield pd.DataFrame({"chat_url": [key[0]], "type": [kind], "new_count": [len(told)], "messages": [told], "total_count": [count]})


def watched(seen: DataFrame, sent: DataFrame, first: int | None = None, compat: bool = False) -> DataFrame:
    """One event a chat and batch of new messages, told apart by sent texts (chat_url, text).

    ``sent`` may be a stream: a text sent at any time accounts for one message
    seen later or in the same batch. If it is a table, it is what a new checkpoint
    begins with. Messages below a chat's mark are not new; of a chat without a
    mark the last ``first`` are read, all of them if it is null. Missing texts
    count as empty ones. With ``compat`` messages are cut to 500 characters
    before they are hashed while sent texts are not.
    """
    prepare(seen.sparkSession)
    rows = seen.select("chat_url", "index", "role", "text").where("index IS NOT NULL")
    initial = None
    if sent.isStreaming:
        empty = F.lit(None)
        rows = rows.unionByName(sent.select("chat_url", empty.cast("long").alias("index"), empty.cast("string").alias("role"), "text"))
    else:
        initial = sent.groupBy("chat_url", external.text_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n")).groupBy("chat_url")
    return rows.groupBy("chat_url").transformWithStateInPandas(_Watch(first, compat), EVENT, "Append", "None", initialState=initial)


class _Throttle(StatefulProcessor):
    """When a chat was last taken."""

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts double")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        taken = []
        for ts in np.sort(np.concatenate([some["ts"].to_numpy(float) for some in rows])).tolist():
            if last is None or ts - last >= self.gap:
                taken.append(ts)
                last = ts
        if taken:
            self.last.update((last,))
            yield pd.DataFrame({"chat_url": key[0], "ts": taken})


def accepted(checks: DataFrame, gap: float = throttle.GAP) -> DataFrame:
    """The streaming form of ``throttle.accepted``: checks (chat_url, ts) of a chat come in order over batches."""
    prepare(checks.sparkSession)
    rows = checks.where("chat_url IS NOT NULL AND ts IS NOT NULL").select("chat_url", "ts")
    return rows.groupBy("chat_url").transformWithStateInPandas(_Throttle(gap), "chat_url string, ts double", "Append", "None")


# State as tables, also of a query that runs: what its last finished batch left.


def _state(spark: SparkSession, checkpoint: str, name: str, operator: int) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).option("operatorId", operator).load(checkpoint)


def live_marks(spark: SparkSession, checkpoint: str, name: str = "seen", operator: int = 0) -> DataFrame:
    """chat_url and last_seen_count of ``resumed_messages``, or with name ``mark`` of ``watched``."""
    return _state(spark, checkpoint, name, operator).select(F.col("key.chat_url").alias("chat_url"), F.col("value.last_seen_count").alias("last_seen_count"))


def live_keys(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """key and first_seen, a number that grows with the time of last sight within a bucket, of ``recent_once``."""
    found = _state(spark, checkpoint, "keys", operator)
    value = F.col("user_map_value.value.stamp") if "value" in found.schema["user_map_value"].dataType.names else F.col("user_map_value.stamp")
    return found.select(F.col("user_map_key.key").alias("key"), value.cast("double").alias("first_seen"))


def live_once(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """key of all that ``once`` has seen."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint).select(F.col("key.key").alias("key"))


def live_sent(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """chat_url, hash and n of texts that were sent and not yet seen by ``watched``."""
    found = _state(spark, checkpoint, "bag", operator)
    return found.select(F.col("key.chat_url").alias("chat_url"), F.col("user_map_key.hash").alias("hash"), F.col("user_map_value.n").alias("n"))
