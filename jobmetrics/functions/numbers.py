"""Rounding, percentages, sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, colour thresholds, node size table and clock tolerance.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
RED_BYTES = 10995116277760
ORANGE_BYTES = 536870912000
GIGABYTE = 1024 * 1024 * 1024
TASK_LIMITS = [50, 100, 500, 1000, 5000, 10000, 50000, 100000]
TASK_RADII = [5, 10, 20, 30, 40, 50, 60, 70]
TWO_DAYS_MS = 172800000


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def giga(x: Column) -> Column:
    return half_up(F.coalesce(x, F.lit(0)) / F.lit(GIGABYTE))


def seconds(millis: Column) -> Column:
    return half_up(F.greatest(F.coalesce(millis, F.lit(0)), F.lit(0)) / F.lit(1000))


def percent(fraction: Column) -> Column:
    """0..1 to a percentage with two decimals; NaN and null count as 0."""
    return F.round(F.lit(100.0) * F.nanvl(F.coalesce(fraction, F.lit(0.0)), F.lit(0.0)), 2)


def pretty_bytes(x: Column) -> Column:
    """Size in the largest unit that leaves more than 1 and at most 1024; null is 0B."""
    size = F.coalesce(x, F.lit(0))
    out = F.concat(half_up(size / F.lit(1)).cast("string"), F.lit(BYTE_UNITS[0]))
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        scaled = F.concat(half_up(size / F.lit(float(1024**power))).cast("string"), F.lit(unit))
        out = F.when(size > F.lit(1024**power), scaled).otherwise(out)
    return out


def size_class(x: Column) -> Column:
    return F.when(x >= RED_BYTES, "red").when(x >= ORANGE_BYTES, "orange").otherwise("green")


def duration_text(millis: Column) -> Column:
    """H:MM:SS, hours not padded."""
    total = F.floor(millis / F.lit(1000)).cast("bigint")
    hours = F.floor(total / F.lit(3600))
    minutes = F.floor(total / F.lit(60)) % 60
    return F.format_string("%d:%02d:%02d", hours, minutes, total % 60)


def repaired_duration(duration_ms: Column, now_ms: Column | int) -> Column:
    """Negative durations, and epochs reported as durations, become 0."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    shown = F.greatest(F.coalesce(duration_ms, F.lit(0)), F.lit(0))
    return F.when(F.abs(now - shown) < TWO_DAYS_MS, F.lit(0).cast("bigint")).otherwise(shown)


def locality_percent(local: Column, maps: Column) -> Column:
    """Share of local tasks in percent; null when there are no map tasks."""
    return F.when(maps > 0, half_up(F.lit(100) * (local / maps)))


def task_radius(tasks: Column) -> Column:
    """Node size for a task count; everything above the last limit gets the largest size."""
    out = F.lit(TASK_RADII[-1])
    for limit, radius in reversed(list(zip(TASK_LIMITS, TASK_RADII))):
        out = F.when(tasks <= limit, radius).otherwise(out)
    return out


def map_group(step_number: Column) -> Column:
    return ((step_number - 1) * 2) % 20


def reduce_group(step_number: Column) -> Column:
    return ((step_number - 1) * 2 + 1) % 20


def has_reduce(reduce_tasks: Column) -> Column:
    return reduce_tasks > 0


def bar_half(progress: Column) -> Column:
    """Width of one half of a progress bar."""
    return half_up(progress / F.lit(2))
