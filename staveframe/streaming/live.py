"""Stream extensions: windowed counts under a watermark, sessions, and labels confirmed as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, label: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """``start, end, label, n, mean`` of tumbling (or sliding) windows of ``events(time, label, value)``; rows later than the
    watermark are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = events.withWatermark(time, late).groupBy(w.alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "label", "n", "mean")


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """``key, start, end, n`` of sessions that end after a gap."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def confirmed_changes(events: DataFrame, key: str, needed: int = 2, idle: int | None = None) -> DataFrame:
    """``key, id, label, changed`` of events ``(key, id, label)`` in the order that they come: a key's label changes once
    ``needed`` events in a row have another one. State is two labels and a count for each key, dropped after ``idle``
    milliseconds without events if that is given (such a query goes on until it is stopped)."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current, rival, run = state.get if state.exists else (None, None, 0)
        out = []
        for batch in batches:
            for i, seen in zip(batch["id"], batch["label"], strict=True):
                changed = False
                if current is None:
                    current, changed = seen, True
                elif seen == current:
                    rival, run = None, 0
                else:
                    run = run + 1 if seen == rival else 1
                    rival = seen
                    if run >= needed:
                        current, rival, run, changed = seen, None, 0, True
                out.append((name[0], i, current, changed))
        state.update((current, rival, run))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[key, "id", "label", "changed"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "id", "label").groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} {kind}, id long, label string, changed boolean", "current string, rival string, run int", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
