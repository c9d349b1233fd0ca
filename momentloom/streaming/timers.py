"""Streams that act on silence: idle keys become errors, unfinished tasks time out at their deadline.

Both keep a few numbers a key and set timers; a key's state goes when it has ended. They need
the RocksDB state store (see use_timers). Keys are long integers; rows with a null key or kind are not
read. Several rows of a key in one batch are taken in the order of their times.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from momentloom.operators.registry import TERMINAL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """Sets the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Idle(StatefulProcessor):
    """Emits (key, state, last_ms, error) once for a key without a sign of life for quiet_ms of processing time."""

    def __init__(self, key: str, quiet_ms: int, waiting: tuple[str, ...]):
        self.key, self.quiet_ms, self.waiting = key, quiet_ms, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # What a lost timer would leave behind goes by itself.
        self.last = handle.getValueState("last", "state string, last_ms long", 10 * self.quiet_ms + 86_400_000)

    def _still(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        state, last = self.last.get() if self.last.exists() else (None, None)
        for frame in rows:
            at = frame["at_ms"].idxmax()
            if last is None or frame["at_ms"][at] >= last:
                state, last = frame["state"][at], int(frame["at_ms"][at])
        self._still()
        if state in TERMINAL:
            self.last.clear()
        else:
            self.last.update((state, last))
            if state not in self.waiting:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            state, last = self.last.get()
            self.last.clear()
            yield pd.DataFrame({self.key: [key[0]], "state": ["error"], "last_ms": [last], "error": [f"interrupted while {state}: no sign of life for {self.quiet_ms // 1000} s"]})
        else:
            yield pd.DataFrame()


def idle_stream(reports: DataFrame, key: str, at_ms: str, state: str, quiet_ms: int = 900_000, waiting: tuple[str, ...] = ("awaiting_approval",)) -> DataFrame:
    """An error row for each key that falls silent without having ended.

    reports are (key, time in ms, state). Every report of a key sets its timer anew, an ended state takes it
    away, and one of waiting may last. A key that reports again after its error starts anew. The error
    comes with the first batch after the quiet time, whether that batch has rows of the key or not.
    """
    rows = reports.filter(F.col(key).isNotNull() & F.col(state).isNotNull() & F.col(at_ms).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(at_ms).alias("at_ms"), F.col(state).alias("state"))
    return rows.groupBy(key).transformWithStateInPandas(Idle(key, quiet_ms, waiting), f"{key} long, state string, last_ms long, error string", "Append", "ProcessingTime")


class Deadline(StatefulProcessor):
    """Emits (key, outcome, at_ms): done where a task finishes by its deadline, else timeout when the watermark passes it."""

    def __init__(self, key: str, limit_ms: int):
        self.key, self.limit_ms = key, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "started long, finished long, ended boolean")

    def _row(self, key: Any, outcome: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "outcome": [outcome], "at_ms": [at]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        started, finished, ended = self.task.get() if self.task.exists() else (None, None, False)
        known = started is not None or finished is not None
        for frame in rows:
            for kind, own in frame.groupby("kind")["ms"].min().items():
                if kind == "start":
                    started = int(own) if started is None else min(started, int(own))
                elif kind == "finish":
                    finished = int(own) if finished is None else min(finished, int(own))
        if started is None and finished is None:
            yield pd.DataFrame()
            return
        at = (started if started is not None else finished) + self.limit_ms
        if not ended and started is not None and finished is not None and finished <= at:
            ended = True
            yield self._row(key, "done", finished)
        if not known or started is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
        self.task.update((started, finished, ended))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, _, ended = self.task.get() if self.task.exists() else (None, None, True)
        self.task.clear()
        yield pd.DataFrame() if ended or started is None else self._row(key, "timeout", started + self.limit_ms)


def deadline_stream(events: DataFrame, key: str, at: str, kind: str, limit_ms: int, late: str = "10 minutes") -> DataFrame:
    """The stream of operators.registry.drained: events (key, at as timestamp, kind) of tasks that start and finish.

    A finish after the timeout row is dropped, as is a finish without a start once as much time has passed. What comes
    later than the watermark allows is lost, as in any stream.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col(kind).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias(key), F.col(at).alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), F.col(kind).alias("kind")).withWatermark("at", late)
    return rows.groupBy(key).transformWithStateInPandas(Deadline(key, limit_ms), f"{key} long, outcome string, at_ms long", "Append", "EventTime")
