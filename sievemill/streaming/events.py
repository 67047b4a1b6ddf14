"""Streaming forms of the sequence operators; an addition, as batch replay is all that stored runs need.

Events are (run_key, ts, value, state). Windows close by the watermark, so state is bounded by its delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_stats(events: DataFrame, window: str, slide: str, late: str) -> DataFrame:
    """Count, mean and range of the value by state in sliding windows."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window, slide), "state")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("range"))
        .select(F.col("window.start").alias("start"), "state", "n", "mean", "range")
    )


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Stretches of activity of a run with pauses below the gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "run_key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "run_key", "n", "peak")
    )


def change_points(events: DataFrame, tolerance: float) -> DataFrame:
    """Events that differ by more than the tolerance from the last one kept of their run; the state of a run is that
    value. Each micro-batch is walked in time order; an event older than its run's last one is passed over."""

    def walk(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        pdf = pd.concat(list(batches)).sort_values("ts")
        kept = []
        for ts, value in zip(pdf["ts"], pdf["value"]):
            us = int(ts.value // 1000)
            if at is not None and us < at:
                continue
            at = us
            if last is None or abs(value - last) > tolerance:
                last = float(value)
                kept.append((key[0], ts, last))
        state.update((last, at))
        yield pd.DataFrame(kept, columns=["run_key", "ts", "value"])

    kind = dict(events.dtypes)["run_key"]
    return events.select("run_key", "ts", "value").groupBy("run_key").applyInPandasWithState(walk, f"run_key {kind}, ts timestamp, value double", "last double, at long", "append", GroupStateTimeout.NoTimeout)
