"""Series for charts and step tables, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmetrics.functions import status as st
from jobmetrics.functions.numbers import (
    GIGABYTE,
    duration_text,
    giga,
    half_up,
    locality_percent,
    pretty_bytes,
    seconds,
    size_class,
)
from jobmetrics.functions.times import chart_label
from jobmetrics.operators.skew import lookup
from jobmetrics.operators.totals import all_tasks, bar_width, time_totals


def _zero(column: str) -> Column:
    return F.coalesce(column, F.lit(0)).cast("bigint")


def _vcore(column: str) -> Column:
    return half_up(F.col(column) / 1000)


def _share(column: str) -> Column:
    return locality_percent(F.col(column), F.col("map_tasks"))


# metric -> red column, blue column, how their values are shown
_GB = lambda column: giga(F.col(column))
_SECS = lambda column: seconds(F.col(column))

STEP_METRICS = {
    "tasks": ("map_tasks", "reduce_tasks", _zero),
    "hdfs_gb": ("hdfs_bytes_read", "hdfs_bytes_written", _GB),
    "gcs_gb": ("gs_bytes_read", "gs_bytes_written", _GB),
    "disk_gb": ("file_bytes_read", "file_bytes_written", _GB),
    "locality": ("data_local_map_tasks", "rack_local_map_tasks", lambda c: F.coalesce(_share(c), F.lit(0))),
    "io_secs": ("io_read_millis", "io_write_millis", _SECS),
    "vcore_secs": ("map_vcore_millis", "reduce_vcore_millis", _vcore),
    "cpu_gc_secs": ("cpu_millis", "gc_millis", _SECS),
}


def _maximum(metric: str, red: str, blue: str) -> Column:
    """Chart maximum: gigabytes are cut off, seconds are rounded."""
    largest = F.greatest(F.max(_zero(red)), F.max(_zero(blue)), F.lit(0))
    if metric.endswith("_gb"):
        return F.floor(largest / F.lit(GIGABYTE)).cast("bigint")
    if metric.endswith("_secs"):
        return half_up(largest / 1000)
    return largest.cast("bigint")


def step_maxima(steps: DataFrame) -> DataFrame:
    """One row per flow with the maximum of each metric."""
    names = {m: (red, blue) for m, (red, blue, _) in STEP_METRICS.items() if m != "locality"}
    return steps.groupBy("flow_id").agg(
        *[_maximum(metric, red, blue).alias(f"max_{metric}") for metric, (red, blue) in names.items()]
    )


def step_series(steps: DataFrame) -> DataFrame:
    """Rows (flow_id, step_number, metric, series, value, max_value): two series for each of eight metrics.

    Maxima are aggregated per flow and joined back, so a flow with very many steps is neither windowed in one
    task nor sorted; adaptive execution may split its side of the join.
    """
    points = []
    for metric, (red, blue, value) in STEP_METRICS.items():
        top = F.lit(100).cast("bigint") if metric == "locality" else F.col(f"max_{metric}")
        for series, column in (("red", red), ("blue", blue)):
            points.append(
                F.struct(
                    F.lit(metric).alias("metric"),
                    F.lit(series).alias("series"),
                    value(column).alias("value"),
                    top.alias("max_value"),
                )
            )
    needed = sorted({c for red, blue, _ in STEP_METRICS.values() for c in (red, blue)})
    joined = lookup(steps.select("flow_id", "step_number", *needed), step_maxima(steps), ["flow_id"])
    return joined.select("flow_id", "step_number", F.explode(F.array(*points)).alias("p")).select(
        "flow_id", "step_number", "p.*"
    )


def step_tips(steps: DataFrame) -> DataFrame:
    """The text for each step and metric."""

    def tip(first: Column, first_text: str, second: Column, second_text: str, tail: str = "in") -> Column:
        return F.concat(
            first, F.lit(first_text), second, F.lit(f"{second_text}, {tail} Job Step "), F.col("step_number").cast("string")
        )

    def text(column: Column) -> Column:
        return column.cast("string")

    def both(metric: str) -> tuple[Column, Column]:
        red, blue, value = STEP_METRICS[metric]
        return text(value(red)), text(value(blue))

    def sizes(metric: str) -> tuple[Column, Column]:
        red, blue, _ = STEP_METRICS[metric]
        return pretty_bytes(F.col(red)), pretty_bytes(F.col(blue))

    local = F.coalesce(text(_share("data_local_map_tasks")), F.lit("?"))
    rack = F.coalesce(text(_share("rack_local_map_tasks")), F.lit("?"))
    (tasks, reduces), (io_r, io_w) = both("tasks"), both("io_secs")
    (vc_m, vc_r), (cpu, gc) = both("vcore_secs"), both("cpu_gc_secs")
    # The wording of the tips.
    tips = {
        "tasks": tip(tasks, " Map Tasks, ", reduces, " Reduce Tasks", "used in"),
        "locality": tip(local, "% Node Local Mappers, ", rack, "% Rack Local Mappers"),
        "io_secs": tip(io_r, " secs IO Read Duration, ", io_w, " secs IO Write Duration"),
        "vcore_secs": tip(vc_m, " Vcore-Seconds Map Tasks, ", vc_r, " Vcore-Seconds Reduce Tasks"),
        "cpu_gc_secs": tip(cpu, " secs CPU time, ", gc, " secs GC time"),
    }
    for metric in ("hdfs_gb", "gcs_gb", "disk_gb"):
        read, written = sizes(metric)
        tips[metric] = tip(read, " Read, ", written, " Written")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), t.alias("tip")) for m, t in tips.items()])
    return steps.select("flow_id", "step_number", F.explode(rows).alias("t")).select("flow_id", "step_number", "t.*")


def history_series(runs: DataFrame) -> DataFrame:
    """Ten metrics per run; values are at least 1. ``runs`` has the flow columns and the totals of the flow; a missing total is 0."""
    label = chart_label(F.col("create_date") * 1000)

    def point(metric: str, value: Column, tip: Column, color: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.greatest(value, F.lit(1)).cast("bigint").alias("value"),
            tip.alias("tip"),
            color.alias("color"),
        )

    status = st.flow_color(F.col("flow_status"))
    minutes = half_up(F.col("flow_duration") / 1000 / 60)
    maps, reduces = _zero("flow_total_map_tasks"), _zero("flow_total_reduce_tasks")
    points = [
        point(
            "running_minutes",
            minutes,
            F.concat(F.col("flow_status"), F.lit(" Running Time: "), duration_text(F.col("flow_duration"))),
            status,
        ),
        point(
            "task_slots",
            all_tasks("flow_total_map_tasks", "flow_total_reduce_tasks"),
            F.concat(F.lit("Map Count: "), maps.cast("string"), F.lit(" Reduce Count: "), reduces.cast("string")),
            F.lit("Indigo"),
        ),
    ]
    # Metrics, the totals they show and their titles.
    for metric, column, title in (
        ("hdfs_written_gb", "flow_hdfs_bytes_written", "Total HDFS Writes: "),
        ("gcs_written_gb", "flow_gs_bytes_written", "Total GS Writes: "),
        ("disk_written_gb", "flow_file_bytes_written", "Cluster Disk Writes: "),
        ("hdfs_read_gb", "flow_hdfs_bytes_read", "Total HDFS Reads: "),
        ("gcs_read_gb", "flow_gs_bytes_read", "Total GS Reads: "),
        ("disk_read_gb", "flow_file_bytes_read", "Cluster Disk Reads: "),
    ):
        size = _zero(column)
        points.append(point(metric, giga(size), F.concat(F.lit(title), pretty_bytes(size)), size_class(size)))
    for metric, millis, title in (
        ("cpu_secs", _zero("flow_cpu_millis"), "Flow CPU time all tasks/cores: "),
        ("vcore_secs", all_tasks("flow_map_vcore_millis", "flow_reduce_vcore_millis"), "Flow VCore time all tasks/cores: "),
    ):
        value = F.greatest(half_up(millis / 1000), F.lit(1))
        tip = F.concat(F.lit(title), duration_text(millis), F.lit(" ("), value.cast("string"), F.lit(" secs)"))
        points.append(point(metric, value, tip, status))
    return runs.select("flow_id", "flow_name", label.alias("label"), F.explode(F.array(*points)).alias("p")).select(
        "flow_id", "flow_name", "label", "p.*"
    )


def time_shares(steps: DataFrame) -> DataFrame:
    """Share of each step in the bar of its flow, in percent, at least 1; null when the bar has no width."""
    share = F.floor(bar_width() / F.col("total_width") * 100).cast("bigint")
    bars = steps.select("flow_id", "step_number", "step_status", "step_running_time")
    joined = lookup(bars, time_totals(steps), ["flow_id"])
    return joined.select(
        "flow_id",
        "step_number",
        F.when(F.col("total_width") != 0, F.when(share == 0, F.lit(1).cast("bigint")).otherwise(share)).alias("share"),
        st.time_text(F.col("step_number"), F.col("step_status"), F.col("step_running_time")).alias("tip"),
        st.cycle_class(F.col("step_number"), F.col("step_status")).alias("color_class"),
    )


def time_labels(steps: DataFrame) -> DataFrame:
    text = st.time_text(F.col("step_number"), F.col("step_status"), F.col("step_running_time"))
    return steps.select("flow_id", "step_number", text.alias("tip"))


def io_rows(steps: DataFrame) -> DataFrame:
    """Read and written amounts by kind. The GCS row is there only when one of its counters is."""

    def row(kind: str, read: Column, written: Column) -> Column:
        return F.struct(F.lit(kind).alias("io_type"), read.alias("read"), written.alias("written"))

    def sizes(kind: str, prefix: str) -> Column:
        return row(kind, pretty_bytes(F.col(f"{prefix}_bytes_read")), pretty_bytes(F.col(f"{prefix}_bytes_written")))

    has_gcs = F.col("gs_bytes_read").isNotNull() | F.col("gs_bytes_written").isNotNull()
    rows = F.array(
        sizes("HDFS", "hdfs"),
        F.when(has_gcs, sizes("GCS", "gs")),
        row("Tuples", F.col("tuples_read").cast("string"), F.col("tuples_written").cast("string")),
        sizes("Cluster Disk", "file"),
    )
    return steps.select("flow_id", "step_number", F.explode(F.array_compact(rows)).alias("r")).select(
        "flow_id", "step_number", "r.*"
    )


def step_stats(steps: DataFrame) -> DataFrame:
    return steps.select(
        "flow_id",
        "step_number",
        _share("data_local_map_tasks").alias("data_local_pct"),
        _share("rack_local_map_tasks").alias("rack_local_pct"),
        "map_tasks",
        "reduce_tasks",
        _vcore("map_vcore_millis").alias("map_vcore_secs"),
        _vcore("reduce_vcore_millis").alias("reduce_vcore_secs"),
    )
