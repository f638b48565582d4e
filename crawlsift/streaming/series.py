"""Captures as a stream: event counts in fixed windows, and sites whose events have gone quiet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Events of each group and tumbling window; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(*by, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Runs of events with less than `gap` between them, of each group."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
