"""Event-time silence detection per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, silent_from timestamp, noticed_at timestamp"


class SilenceProcessor(StatefulProcessor):
    """Emits a key once when no row arrives for ``limit_ms`` of event time."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["ms"].max()) for pdf in rows)
        if self.last.exists():
            before = self.last.get()[0]
            if before >= newest:
                return iter(())
            self.handle.deleteTimer(before + self.limit_ms)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        yield pd.DataFrame(
            {
                "key": [key[0]],
                "silent_from": [pd.Timestamp(last, unit="ms")],
                "noticed_at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")],
            }
        )

    def close(self) -> None:
        pass


def stream_silences(messages: DataFrame, key: str, limit_seconds: int, lateness: str) -> DataFrame:
    """Keys that fell silent; ``messages`` has ``event_time`` (TIMESTAMP)."""
    timed = messages.withWatermark("event_time", lateness).select(
        F.col(key).cast("string").alias("key"), "event_time",
        F.unix_millis("event_time").alias("ms"),
    )
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=SilenceProcessor(limit_seconds * 1000),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="EventTime",
    )
