"""Which checks a minimum gap lets through."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GAP = 10.0


def accepted(checks: DataFrame, gap: float = GAP) -> DataFrame:
    """(chat_url, ts) that are accepted: the first of a chat, then each at least ``gap`` after the last accepted one.

    The decision hangs on the one before, so a chat is walked in order. Rows
    stream through a task sorted by chat and time, and only the last accepted
    time is held, however many checks a chat has.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, last = None, -np.inf
        for rows in batches:
            keep = np.zeros(len(rows), bool)
            urls, times = rows["chat_url"].to_numpy(), rows["ts"].to_numpy(float)
            starts = np.flatnonzero(np.append(True, urls[1:] != urls[:-1])) if len(rows) else []
            for low, high in zip(starts, np.append(starts[1:], len(rows)), strict=True):
                if urls[low] != chat:
                    chat, last = urls[low], -np.inf
                # from one accepted check straight to the next
                while low < high:
                    low = low + bisect_left(times[low:high], True, key=lambda t: t - last >= gap)  # noqa: B023
                    if low < high:
                        keep[low], last = True, times[low]
            yield rows[keep]

    ordered = checks.where("chat_url IS NOT NULL AND ts IS NOT NULL").select("chat_url", "ts")
    return ordered.repartition("chat_url").sortWithinPartitions("chat_url", "ts").mapInPandas(walk, "chat_url string, ts double")
