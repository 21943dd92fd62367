"""Queries: series and step tables (C), load view (J4, J8, C5)."""

from jobmetrics.operators import load, series, totals
from jobmetrics.operators.cluster import describe_flows
from jobmetrics.operators.select import running_flows
from jobmetrics.plans.registry import query
from jobmetrics.plans.settings import (
    CONFIG,
    DESCRIBED,
    FLOW_COLOR_SQL,
    bytes_sql,
    duration_sql,
    giga_sql,
    round_sql,
    size_class_sql,
    utc_sql,
)

_SECS = lambda c: round_sql(f"{c} / 1000")
_SHARE = lambda c: f"case when map_tasks > 0 then {round_sql(f'100 * ({c} / map_tasks)')} else 0 end"
METRICS = {
    "tasks": ("map_tasks", "reduce_tasks", str),
    "hdfs_gb": ("hdfs_bytes_read", "hdfs_bytes_written", giga_sql),
    "gcs_gb": ("gs_bytes_read", "gs_bytes_written", giga_sql),
    "disk_gb": ("file_bytes_read", "file_bytes_written", giga_sql),
    "locality": ("data_local_map_tasks", "rack_local_map_tasks", _SHARE),
    "io_secs": ("io_read_millis", "io_write_millis", _SECS),
    "vcore_secs": ("map_vcore_millis", "reduce_vcore_millis", _SECS),
    "cpu_gc_secs": ("cpu_millis", "gc_millis", _SECS),
}


def _series_sql() -> str:
    parts = []
    for metric, (red, blue, value) in METRICS.items():
        top = f"greatest(max(coalesce({red}, 0)) over w, max(coalesce({blue}, 0)) over w)"
        if metric == "locality":
            top = "100"
        elif metric.endswith("_gb"):
            top = f"cast(floor({top} / 1073741824) as bigint)"
        elif metric.endswith("_secs"):
            top = round_sql(f"{top} / 1000")
        for name, column in (("red", red), ("blue", blue)):
            parts.append(
                f"select flow_id, step_number, '{metric}' as metric, '{name}' as series, cast({value(column)} as bigint) "
                f"as value, cast({top} as bigint) as max_value from steps window w as (partition by flow_id)"
            )
    return " union all ".join(parts)


@query("c1_step_series", _series_sql())
def _(t):
    return series.step_series(t.steps)


@query(
    "a11_step_maxima",
    "select distinct flow_id, "
    + ", ".join(
        f"cast(max(max_value) filter (metric = '{m}') over (partition by flow_id) as bigint) as max_{m}"
        for m in METRICS
        if m != "locality"
    )
    + f" from ({_series_sql()})",
)
def _(t):
    return series.step_maxima(t.steps)


def _tips_sql() -> str:
    step = "' Job Step ' || step_number"
    share = lambda c: f"coalesce(cast({_SHARE(c).replace('else 0', 'else null')} as varchar), '?')"
    tips = {
        "tasks": f"map_tasks || ' Map Tasks, ' || reduce_tasks || ' Reduce Tasks, used in' || {step}",
        "locality": f"{share('data_local_map_tasks')} || '% Node Local Mappers, ' || {share('rack_local_map_tasks')} "
        f"|| '% Rack Local Mappers, in' || {step}",
        "io_secs": f"{_SECS('io_read_millis')} || ' secs IO Read Duration, ' || {_SECS('io_write_millis')} "
        f"|| ' secs IO Write Duration, in' || {step}",
        "vcore_secs": f"{_SECS('map_vcore_millis')} || ' Vcore-Seconds Map Tasks, ' || {_SECS('reduce_vcore_millis')} "
        f"|| ' Vcore-Seconds Reduce Tasks, in' || {step}",
        "cpu_gc_secs": f"{_SECS('cpu_millis')} || ' secs CPU time, ' || {_SECS('gc_millis')} || ' secs GC time, in' || {step}",
    }
    for metric in ("hdfs_gb", "gcs_gb", "disk_gb"):
        red, blue = METRICS[metric][:2]
        tips[metric] = f"{bytes_sql(red)} || ' Read, ' || {bytes_sql(blue)} || ' Written, in' || {step}"
    return " union all ".join(f"select flow_id, step_number, '{m}' as metric, {tip} as tip from steps" for m, tip in tips.items())


@query("c1_step_tips", _tips_sql())
def _(t):
    return series.step_tips(t.steps)


def history_sql() -> str:
    base = ["flow_id", "flow_name", f"{utc_sql('create_date * 1000', '%b %-d, %Y %H:%M:%S')} as label"]

    def part(metric: str, value: str, tip: str, color: str) -> str:
        return f"select {', '.join(base)}, '{metric}' as metric, greatest({value}, 1) as value, {tip} as tip, {color} as color from runs"

    parts = [
        part(
            "running_minutes",
            round_sql("flow_duration / 1000 / 60"),
            f"flow_status || ' Running Time: ' || {duration_sql('flow_duration')}",
            FLOW_COLOR_SQL,
        ),
        part(
            "task_slots",
            "t_map_tasks + t_reduce_tasks",
            "'Map Count: ' || t_map_tasks || ' Reduce Count: ' || t_reduce_tasks",
            "'Indigo'",
        ),
    ]
    for metric, c, title in (
        ("hdfs_written_gb", "t_hdfs_bytes_written", "Total HDFS Writes: "),
        ("gcs_written_gb", "t_gs_bytes_written", "Total GS Writes: "),
        ("disk_written_gb", "t_file_bytes_written", "Cluster Disk Writes: "),
        ("hdfs_read_gb", "t_hdfs_bytes_read", "Total HDFS Reads: "),
        ("gcs_read_gb", "t_gs_bytes_read", "Total GS Reads: "),
        ("disk_read_gb", "t_file_bytes_read", "Cluster Disk Reads: "),
    ):
        parts.append(part(metric, giga_sql(c), f"'{title}' || {bytes_sql(c)}", size_class_sql(c)))
    for metric, c, title in (
        ("cpu_secs", "t_cpu_millis", "Flow CPU time all tasks/cores: "),
        ("vcore_secs", "(t_map_vcore_millis + t_reduce_vcore_millis)", "Flow VCore time all tasks/cores: "),
    ):
        secs = f"greatest({round_sql(f'{c} / 1000')}, 1)"
        parts.append(part(metric, secs, f"'{title}' || {duration_sql(c)} || ' (' || {secs} || ' secs)'", FLOW_COLOR_SQL))
    return " union all ".join(parts)


_TOTALS = ", ".join(
    f"coalesce(t_{c}, 0) as t_{c}"
    for c in (
        "map_tasks", "reduce_tasks", "hdfs_bytes_written", "gs_bytes_written", "file_bytes_written", "hdfs_bytes_read",
        "gs_bytes_read", "file_bytes_read", "cpu_millis", "map_vcore_millis", "reduce_vcore_millis",
    )
)


@query(
    "c2_history_series",
    history_sql(),
    {
        "runs": f"select f.*, {_TOTALS} from flows f left join totals t using (flow_id) "
        "where flow_status in ('STOPPED', 'FAILED', 'SUCCESSFUL')"
    },
)
def _(t):
    finished = t.flows.filter("flow_status in ('STOPPED', 'FAILED', 'SUCCESSFUL')")
    return series.history_series(finished.join(totals.flow_totals(t.steps), "flow_id", "left"))


TIP_SQL = """'Step ' || step_number || ': ' || case when step_status in ('PENDING', 'SUBMITTED', 'STARTED', 'NOT_LAUNCHED')
    then 'Unknown' else step_running_time || ' secs' end"""


@query(
    "c3_time_shares",
    f"""select flow_id, step_number, case when total = 0 then null else greatest(cast(floor(w / total * 100) as bigint), 1) end
        as share, {TIP_SQL} as tip, 'color-cycle-' || case step_status when 'RUNNING' then 'orange' when 'FAILED' then 'red'
        when 'SUCCESSFUL' then 'green' else 'grey' end || '-' || (step_number % 3 + 1) as color_class
    from (select *, sum(w) over (partition by flow_id) as total from
        (select *, case when step_status = 'RUNNING' then 2 else step_running_time end as w from steps))""",
)
def _(t):
    return series.time_shares(t.steps)


@query("c4_time_labels", f"select flow_id, step_number, {TIP_SQL} as tip from steps")
def _(t):
    return series.time_labels(t.steps)


@query(
    "c6_io_rows",
    " union all ".join(
        f"select flow_id, step_number, '{kind}' as io_type, {read} as read, {written} as written from steps {where}"
        for kind, read, written, where in (
            ("HDFS", bytes_sql("hdfs_bytes_read"), bytes_sql("hdfs_bytes_written"), ""),
            ("GCS", bytes_sql("gs_bytes_read"), bytes_sql("gs_bytes_written"), "where gs_bytes_read is not null or gs_bytes_written is not null"),
            ("Tuples", "cast(tuples_read as varchar)", "cast(tuples_written as varchar)", ""),
            ("Cluster Disk", bytes_sql("file_bytes_read"), bytes_sql("file_bytes_written"), ""),
        )
    ),
)
def _(t):
    return series.io_rows(t.steps)


_NULL_SHARE = lambda c: _SHARE(c).replace("else 0", "else null")


@query(
    "c7_step_stats",
    f"select flow_id, step_number, {_NULL_SHARE('data_local_map_tasks')} as data_local_pct, "
    f"{_NULL_SHARE('rack_local_map_tasks')} as rack_local_pct, map_tasks, reduce_tasks, "
    f"{_SECS('map_vcore_millis')} as map_vcore_secs, {_SECS('reduce_vcore_millis')} as reduce_vcore_secs from steps",
)
def _(t):
    return series.step_stats(t.steps)


_RADIUS = lambda c: (
    f"case when {c} <= 50 then 5 when {c} <= 100 then 10 when {c} <= 500 then 20 when {c} <= 1000 then 30 "
    f"when {c} <= 5000 then 40 when {c} <= 10000 then 50 when {c} <= 50000 then 60 else 70 end"
)
RUNNING_FLOWS = "select * from described where flow_status in ('RUNNING', 'SUBMITTED', 'STARTED')"
JOB_NODES = """select 'job:' || flow_id as node_id, flow_name || ' (' || user_name || ')' as name, 31337 as node_group,
    20 as radius, flow_id, cast(null as varchar) as parent_id, truncated_name as txt from busy"""
TASK_NODES = f"""select 'map:' || flow_id || ':' || step_number as node_id,
        'step: ' || step_number || ' | ' || map_tasks || ' mappers' as name, (step_number - 1) * 2 % 20 as node_group,
        {_RADIUS('map_tasks')} as radius, null as flow_id, flow_id as parent_id, map_tasks || ' mappers' as txt
    from steps where step_status = 'RUNNING' and flow_id in (select flow_id from busy)
    union all select 'reduce:' || flow_id || ':' || step_number,
        'step: ' || step_number || ' | ' || reduce_tasks || ' reducers', ((step_number - 1) * 2 + 1) % 20,
        {_RADIUS('reduce_tasks')}, null, flow_id, reduce_tasks || ' reducers'
    from steps where step_status = 'RUNNING' and reduce_tasks > 0 and flow_id in (select flow_id from busy)"""
BUSY = {"described": DESCRIBED, "busy": RUNNING_FLOWS, "task_nodes": TASK_NODES}


def busy_flows(t):
    return describe_flows(running_flows(t.flows, 0, 0), CONFIG)


@query("c5_t2_load_nodes", f"select * from task_nodes union all {JOB_NODES}", BUSY)
def _(t):
    return load.load_nodes(busy_flows(t), t.steps)


@query("j4_load_links", "select node_id as source, 'job:' || parent_id as target from task_nodes", BUSY)
def _(t):
    flows = busy_flows(t)
    return load.load_links(load.task_nodes(flows, t.steps), load.job_nodes(flows))


@query(
    "j8_flows_with_steps",
    "select f.flow_id, f.flow_status, s.step_number, s.step_status from flows f left join steps s using (flow_id)",
)
def _(t):
    return load.flows_with_steps(
        t.flows.select("flow_id", "flow_status"), t.steps.select("flow_id", "step_number", "step_status")
    )
