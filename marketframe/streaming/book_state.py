"""Stateful order book: the streaming twin of the interval reconstruction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = (
    "symbol string, seq long, ts timestamp_ntz, side string, price double, size double"
)


class BookProcessor(StatefulProcessor):
    """Keeps price -> size per side; emits the book at every ``every``-th message.

    Messages are counted from 1 per symbol in order of arrival.  A snapshot replaces both
    sides, a delta sets or (size 0) deletes levels, and deltas before the first snapshot
    are counted and otherwise ignored.
    """

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.ready = handle.getValueState("ready", "flag boolean")
        self.levels = handle.getMapState("levels", "side string, price double", "size double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        messages = pd.concat(list(rows), ignore_index=True).sort_values("seq")
        out = []
        before = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((before + len(messages),))
        for number, msg in enumerate(messages.itertuples(index=False), before + 1):
            if msg.type == "snapshot":
                self.levels.clear()
                self.ready.update((True,))
            elif not self.ready.exists():
                continue
            for side, changes in (("b", msg.b), ("a", msg.a)):
                for level in changes:
                    slot, size = (side, float(level[0])), float(level[1])
                    if size != 0:
                        self.levels.updateValue(slot, (size,))
                    elif self.levels.containsKey(slot):
                        self.levels.removeKey(slot)
            if number % self.every == 0:
                out += [
                    (key[0], msg.seq, msg.ts, s[0], s[1], v[0]) for s, v in self.levels.iterator()
                ]
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def stream_book(msgs: DataFrame, every: int = 50) -> DataFrame:
    """Sampled book levels from a message stream, keyed by symbol.

    Needs the RocksDB state store.  Rows go to ``book.top_levels`` and
    ``book.book_metrics`` as in batch.
    """
    return msgs.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=BookProcessor(every),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="none",
    )
