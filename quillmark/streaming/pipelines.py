"""The engine's operators over streams. Rules are stateless projections; counts, sessions and the latest health keep state under a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.plans.rules import Scanner, flags

LATE = "10 minutes"


def flag_stream(transcripts: DataFrame, scanners: list[Scanner], key: str = "doc_id") -> DataFrame:
    """Flags of each transcript as it arrives; the same plan as in batch, so the same flags."""
    return flags(transcripts, scanners, key)


def tumbling(events: DataFrame, length: str, by: str, late: str = LATE) -> DataFrame:
    """(start, by, n) for each window of a length; windows end when the watermark has passed them."""
    return _counted(events.withWatermark("ts", late), F.window("ts", length), by)


def sliding(events: DataFrame, length: str, step: str, by: str, late: str = LATE) -> DataFrame:
    return _counted(events.withWatermark("ts", late), F.window("ts", length, step), by)


def _counted(events: DataFrame, window, by: str) -> DataFrame:
    return events.groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str, by: str, late: str = LATE) -> DataFrame:
    """(by, start, end, n): bursts of events with no pause of gap."""
    return events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """Events without those that repeat a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_health(health: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(witness, status, ts): the newest status of each witness, emitted when it changes. State is one pair for each witness of a roster;
    with idle_ms, a witness that is silent for so long is forgotten.

    A late report never replaces a newer one, whatever the order of arrival.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        was = state.get if state.exists else None
        best = was
        for b in batches:
            for ts, status in zip(b["ts"].astype("int64"), b["status"]):
                if best is None or (int(ts), status) > best:
                    best = (int(ts), status)
        state.update(best)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if was is None or was[1] != best[1]:
            yield pd.DataFrame({"witness": [key[0]], "status": [best[1]], "ts_ns": [best[0]]})

    return health.groupBy("witness").applyInPandasWithState(update, "witness string, status string, ts_ns long", "ts long, status string", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
