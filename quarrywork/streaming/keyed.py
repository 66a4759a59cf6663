"""Keyed state with event-time timers: debounce and queues, the same however a stream is cut into micro-batches.

Rows of a key are kept until the watermark has passed them and then taken in order of time and number, so neither the size
of a trigger, nor the order of rows that come within :data:`~quarrywork.streaming.changes.LATE`, nor a restart changes what comes
out. What is after the last watermark waits for more input.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .changes import LATE

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "at long, number long, kind string, done boolean"
_STATE = "since long, last long, kind string, rows long"


@contextmanager
def keyed_state(spark: SparkSession):
    """While a stream starts: states with timers need a store with column families."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _InOrder(StatefulProcessor):
    """Holds a key's rows back until the watermark has passed them; ``step`` and ``rest`` say what they do to its state.

    A key has a timer at or before its earliest row and, where a state ends by itself, one for that: not one for each row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [x for batch in rows for x in zip(batch["at"].tolist(), batch["number"].tolist(), batch["kind"].tolist(), batch["done"].tolist())]
        new = [x for x in new if x[0] > passed]  # what comes later than the watermark allows
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(x[0] for x in new) // 1000))  # one of the earliest takes all that is due by then
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in every if x[0] <= passed]
        if due and len(due) < len(every):
            self.waiting.put(every[len(due) :])
            self.handle.registerTimer(-(-every[len(due)][0] // 1000))
        elif due:
            self.waiting.clear()
        state = self.state.get() if self.state.exists() else None
        found = []
        for at, _, kind, done in due:
            state = self.step(key, state, at, kind, done, found)
        state = self.rest(key, state, passed, found)
        if state is not None:
            self.state.update(tuple(state))
        elif self.state.exists():
            self.state.clear()
        if found:
            yield pd.DataFrame(found, columns=self.columns)


class _Debounce(_InOrder):
    columns = ["path", "kind", "at", "events"]

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def step(self, key, state, at, kind, done, found):
        if state is not None and at - state[1] >= self.quiet:
            found.append((*key, state[2], state[1], state[3]))
            state = None
        return (state[0], at, kind, state[3] + 1) if state is not None else (at, at, kind, 1)

    def rest(self, key, state, passed, found):
        if state is not None and state[1] + self.quiet <= passed:
            found.append((*key, state[2], state[1], state[3]))
            return None
        if state is not None:
            self.handle.registerTimer(-(-(state[1] + self.quiet) // 1000))
        return state


class _Queue(_InOrder):
    columns = ["path", "since"]

    def step(self, key, state, at, kind, done, found):
        if done:
            return None
        if state is None:
            found.append((*key, at))
            return (at, at, kind, 1)
        return (state[0], at, kind, state[3] + 1)

    def rest(self, key, state, passed, found):
        return state


def _keyed(events: DataFrame, key: str, done: Column | None) -> DataFrame:
    rows = events.withWatermark("ts", LATE).select(
        F.col(key).alias("path"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("number"), "kind",
        F.coalesce(done, F.lit(False)).alias("done") if done is not None else F.lit(False).alias("done"),
    )
    return rows.groupBy("path")


def debounced(events: DataFrame, quiet: int, key: str = "path") -> DataFrame:
    """(path, kind, at, events): one row for each burst of a key's changes, its last kind (the last writer wins), once nothing came
    for ``quiet`` microseconds. ``events`` has (event_id, ts, kind) and the key."""
    return _keyed(events, key, None).transformWithStateInPandas(
        _Debounce(quiet), "path string, kind string, at long, events long", "append", "eventTime"
    )


def queued(events: DataFrame, done: Column, key: str = "path") -> DataFrame:
    """(path, since): a row whenever a key enters the queue. While it waits it isn't taken in again; a row for which ``done`` holds
    takes it out."""
    return _keyed(events, key, done).transformWithStateInPandas(_Queue(), "path string, since long", "append", "eventTime")
