"""Starts and stops of a monitor, and its status as the engine reports it.

Each start is an epoch with a queue and counters of its own. Marks and keys
already handled stay in the checkpoint from one epoch to the next.
"""

from __future__ import annotations

import re
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import status
from . import monitor

OBSERVED = "looks"
EPOCHS = "epoch long, run_id string, mode string, started_at double"
LOOKS = (
    "running boolean, mode string, started_at double, uptime_sec long, scan_count long, trigger_count long, active_chat_url string, "
    "last_error string, last_error_at double, last_sync_at double"
)


@dataclass
class Count:
    started_at: float
    scans: int = 0
    triggers: int = 0
    running: bool = True
    last_error: str | None = None
    last_error_at: float | None = None
    last_sync_at: float | None = None
    batches: set[int] = field(default_factory=set)


class Looks(StreamingQueryListener):
    """Counts of each run of a query, fed by the engine: a look is a finished batch, also one that found nothing.

    Triggers are rows that ``observed`` counted; a batch that is reported twice
    counts once. Add it with ``spark.streams.addListener``. Reports arrive some
    time after what they report.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._runs: dict[str, Count] = {}

    def _run(self, run_id: object) -> Count:
        return self._runs.setdefault(str(run_id), Count(time.time()))

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._run(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            run = self._run(progress.runId)
            if progress.batchId in run.batches:
                return
            run.batches = {progress.batchId}  # they come in order
            run.scans += 1
            found = progress.observedMetrics.get(OBSERVED)
            run.triggers += int(found["triggers"]) if found is not None else 0
            run.last_sync_at = time.time()

    def onQueryIdle(self, event) -> None:
        with self._lock:
            run = self._run(event.runId)
            run.scans += 1
            run.last_sync_at = time.time()

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            run = self._run(event.runId)
            run.running = False
            if event.exception:
                # the innermost of the errors that name their class, beneath what carried it
                named = re.findall(r"\[[A-Z][A-Z0-9_.]+\] [^\n]*", event.exception)
                run.last_error = named[-1] if named else event.exception.split("\n", 1)[0]
                run.last_error_at = time.time()

    def settle(self, query: StreamingQuery, seconds: float = 30.0) -> None:
        """Wait until the last batch and the end of a stopped query have been reported."""
        last, end = query.lastProgress, time.time() + seconds
        while time.time() < end:
            with self._lock:
                run = self._run(query.runId)
                if not run.running and (last is None or run.batches and max(run.batches) >= last["batchId"]):
                    return
            time.sleep(0.05)

    def count(self, run_id: object) -> Count:
        """What is known of a run so far."""
        with self._lock:
            run = self._run(run_id)
            return Count(run.started_at, run.scans, run.triggers, run.running, run.last_error, run.last_error_at, run.last_sync_at)


def observed(events: DataFrame) -> DataFrame:
    """The same rows, counted for ``Looks``."""
    return events.observe(OBSERVED, F.count(F.lit(1)).alias("triggers"))


@dataclass
class Run:
    query: StreamingQuery
    epoch: int
    mode: str
    active: str
    folder: str
    schema: str
    looks: Looks

    def queue(self, spark: SparkSession, after: int = -1) -> tuple[DataFrame, int]:
        """Events of this epoch beyond a batch, and the last batch read."""
        return monitor.drain(spark, f"{self.folder}/epoch={self.epoch}", after, self.schema)


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.read_json(spark, f"{folder}-epochs", EPOCHS)


def start(
    events: DataFrame,
    folder: str,
    checkpoint: str,
    looks: Looks,
    mode: str = "project_recent",
    active: str = "",
    running: Run | None = None,
    seconds: float = monitor.ACTIVE_SECONDS,
) -> tuple[str, Run]:
    """Begin an epoch: its queue is empty and its counters are zero, whatever ran before over this checkpoint.

    ``running`` is a run that may still go on; then nothing is started. A batch
    that an earlier epoch left unfinished is run again in this one.
    """
    if mode not in status.MODES:
        raise ValueError(f"mode is one of {', '.join(status.MODES)}")
    if running is not None and running.query.isActive:
        return "already_running", running
    spark = events.sparkSession
    last = epochs(spark, folder).agg(F.max("epoch")).first()[0]
    epoch = 0 if last is None else last + 1
    writer = monitor.logged(observed(events), f"{folder}/epoch={epoch}", checkpoint)
    query = writer.trigger(processingTime=f"{int(1000 * seconds)} milliseconds").start()
    row = [(epoch, str(query.runId), mode, time.time())]
    spark.createDataFrame(row, EPOCHS).coalesce(1).write.mode("append").json(f"{folder}-epochs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return "started", Run(query, epoch, mode, active, folder, schema, looks)


def stop(run: Run) -> dict[str, object]:
    """End a run; its checkpoint, with marks and keys, stays for the next epoch."""
    said = monitor.stop(run.query)
    count = run.looks.count(run.query.runId)
    return {"status": said, "total_scans": count.scans, "total_triggers": count.triggers}


def current(spark: SparkSession, run: Run, now: float | None = None) -> DataFrame:
    """What the engine has reported of a run, as one row."""
    count, now = run.looks.count(run.query.runId), time.time() if now is None else now
    row = (run.query.isActive, run.mode, count.started_at, int(now - count.started_at), count.scans, count.triggers, run.active, count.last_error, count.last_error_at, count.last_sync_at)
    return spark.createDataFrame([row], LOOKS)


def full(spark: SparkSession, run: Run, marks: DataFrame, keys: DataFrame, now: float | None = None) -> DataFrame:
    """All of the status of a run, also of one that goes on: ``marks`` and ``keys`` are of its state (``state.live_marks``, ``state.live_keys``)."""
    return status.with_sizes(current(spark, run, now), marks, run.queue(spark)[0], keys)
