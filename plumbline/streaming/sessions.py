"""Repeats within sessions over a stream: the state of a session is its number of compactions and, by path, the one at its
last delivery, a key of a map each. A trigger reads and writes the keys of its own events, never a session's history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session long, ord long, path string, compacts long, seen_before boolean, after_compact boolean"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Repeats(StatefulProcessor):
    """Deliveries of a session, in order of `ord` over triggers and within one. After `idle` milliseconds without an event, the
    session is forgotten; a path's own key expires by itself when it is not delivered for as long."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.compacts = handle.getValueState("compacts", "n long", self.idle)
        self.seen = handle.getMapState("seen", "path string", "compacts long", self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        compacts = self.compacts.get()[0] if self.compacts.exists() else 0
        out = []
        for e in pd.concat(list(rows)).sort_values("ord").itertuples():
            if e.kind == "compact":
                compacts += 1
                continue
            path = ("" if e.path is None else e.path,)
            before = self.seen.getValue(path)[0] if self.seen.containsKey(path) else None
            out.append((key[0], e.ord, e.path, compacts, before is not None, before is not None and compacts > before))
            self.seen.updateValue(path, (compacts,))
        self.compacts.update((compacts,))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timers: object, expired: object) -> Iterator[pd.DataFrame]:
        self.compacts.clear()
        self.seen.clear()
        yield pd.DataFrame([], columns=_COLUMNS)

    def close(self) -> None:
        pass


def repeats(events: DataFrame, idle: str | None = "24 hours") -> DataFrame:
    """Deliveries (session, ord, path, compacts, seen_before, after_compact) of a stream (session, ord, kind, path).

    Events of a session come in order of `ord` over triggers; within one they are sorted. A null path is one path. A session
    without events for `idle` is forgotten, which bounds the state by the sessions that are active; with None, none is. The
    state is kept by RocksDB: the query's session needs `STORE` as its state store.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return events.groupBy("session").transformWithStateInPandas(Repeats(wait), OUT, "append", "ProcessingTime" if wait else "None")


#: Setting and value of a session that runs such queries.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
