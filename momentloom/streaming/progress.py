"""Structured Streaming twins of the progress operators: throttled reports, changed snapshots, idle keys.

Each is bounded state per key. Extensions of the batch operators in operators/series.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttle_stream(reports: DataFrame, key: str, order: str, fraction: str, step: int) -> DataFrame:
    """Reports (key, order, fraction as integer) whose fraction has advanced by step since the key's last one let through; those without a fraction are not."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (0,)
        for frame in frames:
            own = frame.dropna(subset=[fraction]).sort_values(order, kind="stable")
            values, kept = own[fraction].to_numpy(np.int64), []
            at = 0
            while (ahead := np.flatnonzero(values[at:] - last >= step)).size:
                at += int(ahead[0])
                last = int(values[at])
                kept.append(at)
            yield own.iloc[kept][[key, order, fraction]]
        state.update((last,))

    schema = f"{key} long, {order} long, {fraction} long"
    return reports.select(key, order, fraction).groupBy(key).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def change_stream(snapshots: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Snapshots that differ from the key's one before, the first included. No value is a value: it differs from all others and equals itself."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = (True, state.get[0]) if state.exists else (False, None)
        for frame in frames:
            own = frame.sort_values(order, kind="stable")
            values = own[value].astype("Int64")
            before = values.shift(1, fill_value=pd.NA if last is None else last)
            same = (values == before).fillna(False).astype(bool) | (values.isna() & before.isna())
            if len(own) and not known:
                same.iloc[0] = False
            if len(own):
                known, last = True, None if pd.isna(values.iloc[-1]) else int(values.iloc[-1])
            yield own.assign(**{value: values})[[key, order, value]][~same.to_numpy()]
        if known:
            state.update((last,))

    return snapshots.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long, {value} long", "last long", "append", GroupStateTimeout.NoTimeout)


def activity_windows(events: DataFrame, key: str, at: str, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key's events, closed after `gap` without any, with a watermark for late events."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
