"""Epoch times as text, in UTC whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _utc(epoch_ms: Column) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MILLISECOND", epoch_ms, start)


def date_text(epoch_ms: Column) -> Column:
    """``MM-DD-YYYY HH:mm:ss UTC``; empty for 0."""
    return F.when(epoch_ms == 0, "").otherwise(
        F.concat(F.date_format(_utc(epoch_ms), "MM-dd-yyyy HH:mm:ss"), F.lit(" UTC"))
    )


def chart_label(epoch_ms: Column) -> Column:
    """``Mon D, YYYY HH:MM:SS``."""
    return F.date_format(_utc(epoch_ms), "MMM d, yyyy HH:mm:ss")
