"""Aggregates over the steps of each flow."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmetrics.schemas import FLOW_TOTALS


def _hundredths(progress: str) -> Column:
    return F.round(F.coalesce(progress, F.lit(0.0)) * 100).cast("bigint")


def _progress() -> Column:
    """Mean progress of all map stages and all existing reduce stages. Progress has two decimals, so it is
    summed as whole hundredths: the result does not depend on the order of the rows."""
    reduces = F.coalesce("has_reduce_stage", F.lit(False))
    total = F.sum(_hundredths("map_progress") + F.when(reduces, _hundredths("reduce_progress")).otherwise(0))
    stages = F.count(F.lit(1)) + F.count_if(reduces)
    return F.floor((total * 2 + stages) / (stages * 2)) / F.lit(100.0)


def flow_progress(steps: DataFrame) -> DataFrame:
    return steps.groupBy("flow_id").agg(_progress().alias("flow_progress"))


def flow_totals(steps: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Progress, counter totals and any ``extra`` aggregates of each flow in one pass."""
    sums = [
        F.sum(F.coalesce(column, F.lit(0))).alias(name) for name, column in FLOW_TOTALS.items() if column in steps.columns
    ]
    more = [column.alias(name) for name, column in (extra or {}).items()]
    return steps.groupBy("flow_id").agg(_progress().alias("flow_progress"), *sums, *more)


def field_of(document: Column, name: str, kind: str) -> Column:
    """A field of an open document (a variant) as ``kind``; null where it is absent or no such value."""
    return F.try_variant_get(document, f'$["{name}"]', kind)


def aggregate_or(aggregated: Column, name: str, default: float | int) -> Column:
    """An aggregate kept with the flow (variant), or the default, in the default's type."""
    kind = "bigint" if isinstance(default, int) else "double"
    return F.coalesce(field_of(aggregated, name, kind), F.lit(default).cast(kind))


def stored_totals(flows: DataFrame) -> DataFrame:
    """The aggregates kept with each flow (variant ``aggregated``) as columns: progress and the counter totals, null where absent
    or not a number."""
    kept = F.col("aggregated")
    totals = {name: field_of(kept, name, "bigint") for name in FLOW_TOTALS}
    return flows.withColumns({"flow_progress": field_of(kept, "flow_progress", "double"), **totals})


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins."""
    kept = F.map_filter(left, lambda key, _: ~F.map_contains_key(right, key))
    return F.map_concat(kept, right)


def total_stages(steps: DataFrame) -> DataFrame:
    return steps.groupBy("flow_id").agg(F.count_distinct("step_number").alias("total_stages"))


def time_totals(steps: DataFrame) -> DataFrame:
    """Total bar width per flow; a running step counts as 2."""
    return steps.groupBy("flow_id").agg(F.ceil(F.sum(bar_width())).cast("bigint").alias("total_width"))


def bar_width() -> Column:
    return F.when(F.col("step_status") == "RUNNING", F.lit(2).cast("bigint")).otherwise(F.col("step_running_time"))


def all_tasks(map_tasks: str, reduce_tasks: str) -> Column:
    return F.coalesce(map_tasks, F.lit(0)) + F.coalesce(reduce_tasks, F.lit(0))
