"""Streams of plant-register changes: the latest state of each plant, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum of ``value`` per window and key; rows later than the watermark are dropped by Spark."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), F.col(key), "n", "total")
    )


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Visits of a user: runs of events with gaps below ``gap``."""
    return (
        events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
    )


def latest_state(changes: DataFrame, seconds: int = 7200, key: str = "user_id") -> DataFrame:
    """The newest value of each key as it changes; state that no change has touched for ``seconds`` is forgotten.

    changes: (key, ts, value) with a watermark on ts. An older change never replaces a newer one, whatever its order.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, value = state.get if state.exists else (pd.Timestamp.min.value // 1000, None)
        for b in batches:
            at = b["ts"].astype("datetime64[us]").astype("int64")
            i = at.to_numpy().argmax()
            if at.iloc[i] > newest:
                newest, value = int(at.iloc[i]), float(b["value"].iloc[i])
        state.update((newest, value))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + 1000 * seconds)
        yield pd.DataFrame({key: [k[0]], "ts_us": [newest], "value": [value]})

    return changes.select(key, "ts", "value").groupBy(key).applyInPandasWithState(
        update, f"{key} long, ts_us long, value double", "ts_us long, value double", "update", GroupStateTimeout.EventTimeTimeout
    )
