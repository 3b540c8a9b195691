"""Counts of events in windows of event time, on streams and tables alike.

With ``late`` a stream keeps a window open until an event is that much younger than its end; what comes
later still is dropped. A table has no late rows: the same call counts all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(events: DataFrame, window: Column, by: list[str], at: str, value: str, late: str | None) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    found = rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.max(value).alias("highest"))
    return found.select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), *by, "n", "highest")


def tumbling(events: DataFrame, length: str, by: list[str], at: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """begins, ends, the columns ``by``, n and highest of windows that follow each other."""
    return _counted(events, F.window(at, length), by, at, value, late)


def sliding(events: DataFrame, length: str, step: str, by: list[str], at: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """The same of windows that begin every ``step`` and overlap."""
    return _counted(events, F.window(at, length, step), by, at, value, late)


def sessions(events: DataFrame, gap: str, by: list[str], at: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """The same of sessions: runs of events of one group, each less than ``gap`` after the one before; a session ends ``gap`` after its last event."""
    return _counted(events, F.session_window(at, gap), by, at, value, late)
