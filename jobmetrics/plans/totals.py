"""Queries: aggregates (A), maps (T3) and the listing (P5)."""

from pyspark.sql import functions as F

from jobmetrics.operators import cluster, totals, unpack
from jobmetrics.operators.select import newest_first, running_flows
from jobmetrics.plans.registry import query
from jobmetrics.plans.settings import CONFIG, DESCRIBED, date_sql, duration_sql

PROGRESS = """(2 * (sum(cast(round(map_progress * 100) as bigint))
        + sum(case when has_reduce_stage then cast(round(reduce_progress * 100) as bigint) else 0 end))
        + count(*) + count(*) filter (has_reduce_stage))
    // (2 * (count(*) + count(*) filter (has_reduce_stage))) / 100.0"""
PROGRESS_SQL = f"select flow_id, cast({PROGRESS} as double) as flow_progress from steps group by flow_id"


@query("a1_flow_progress", "select f.flow_id, p.flow_progress from flows f left join progress p using (flow_id)", {"progress": PROGRESS_SQL})
def _(t):
    return t.flows.select("flow_id").join(totals.flow_progress(t.steps), "flow_id", "left")


_SUMMED = {
    "flow_hdfs_bytes_read": "hdfs_bytes_read",
    "flow_file_bytes_read": "file_bytes_read",
    "flow_gs_bytes_read": "gs_bytes_read",
    "flow_hdfs_bytes_written": "hdfs_bytes_written",
    "flow_file_bytes_written": "file_bytes_written",
    "flow_gs_bytes_written": "gs_bytes_written",
    "flow_total_map_tasks": "map_tasks",
    "flow_total_reduce_tasks": "reduce_tasks",
    "flow_map_vcore_millis": "map_vcore_millis",
    "flow_reduce_vcore_millis": "reduce_vcore_millis",
    "flow_shuffled_maps": "shuffled_maps",
    "flow_map_records_out": "map_records_out",
    "flow_reduce_records_in": "reduce_records_in",
    "flow_reduce_records_out": "reduce_records_out",
    "flow_map_bytes_out": "map_bytes_out",
    "flow_merged_map_outputs": "merged_map_outputs",
    "flow_reduce_shuffle_bytes": "reduce_shuffle_bytes",
    "flow_cpu_millis": "cpu_millis",
    "flow_gc_millis": "gc_millis",
    "flow_spilled_records": "spilled_records",
    "flow_heap_committed_bytes": "heap_committed_bytes",
    "flow_virtual_mem_bytes": "virtual_mem_bytes",
    "flow_physical_mem_bytes": "physical_mem_bytes",
    "flow_tuples_read": "tuples_read",
    "flow_tuples_written": "tuples_written",
}
_SUMS = ", ".join(f"cast(sum(coalesce({column}, 0)) as bigint) as {name}" for name, column in _SUMMED.items())


@query("a2_flow_totals", f"select flow_id, cast({PROGRESS} as double) as flow_progress, {_SUMS} from steps group by flow_id")
def _(t):
    return totals.flow_totals(t.steps)


@query(
    "a3_extra_aggregates",
    "select flow_id, max(step_running_time) as longest_step, count(distinct step_status) as n_statuses, "
    "cast(sum(cpu_millis) as bigint) as flow_cpu_millis from steps group by flow_id",
)
def _(t):
    extra = {"longest_step": F.max("step_running_time"), "n_statuses": F.count_distinct("step_status")}
    return totals.flow_totals(t.steps, extra).select("flow_id", "longest_step", "n_statuses", "flow_cpu_millis")


@query(
    "a4_aggregate_or",
    "select f.flow_id, cast(coalesce(t.t_cpu_millis, -1) as double) as cpu, cast(-2.5 as double) as missing "
    "from flows f left join totals t using (flow_id)",
)
def _(t):
    sums = totals.flow_totals(t.steps).select(
        "flow_id", F.to_variant_object(F.create_map(F.lit("flow_cpu_millis"), F.col("flow_cpu_millis"))).alias("aggregated")
    )
    aggregated = F.col("aggregated")
    return t.flows.select("flow_id").join(sums, "flow_id", "left").select(
        "flow_id",
        totals.aggregate_or(aggregated, "flow_cpu_millis", -1.0).alias("cpu"),
        totals.aggregate_or(aggregated, "no_such_total", -2.5).alias("missing"),
    )


# Raw counters of the updates: dotted group names, several values per counter, the last one counts.
RAW_GROUPS = {
    "org.apache.hadoop.mapreduce.JobCounter": ["map_tasks", "reduce_tasks"],
    "org.apache.hadoop.org.apache.hadoop.mapreduce.TaskCounter": ["cpu_millis"],
    "cascading.flow.StepCounters$Kind": ["tuples_read"],
}
CLEAN = {g: g.replace("org.apache.hadoop.", "").split("$")[0] for g in RAW_GROUPS}


def raw_counters(t):
    rows = F.array(
        *[
            F.struct(F.lit(g).alias("group_name"), F.lit(c).alias("counter_name"), F.col(c).cast("bigint").alias("value"))
            for g, names in RAW_GROUPS.items()
            for c in names
        ]
    )
    seq = F.struct("arrived", "seq_a", "seq_b").alias("seq")
    return t.step_updates.select("flow_id", "step_id", seq, F.explode(rows).alias("r")).select("flow_id", "step_id", "seq", "r.*")


COUNTER_ROWS = " union all ".join(
    f"select flow_id, step_id, '{CLEAN[g]}' as group_name, '{c}' as counter_name, cast({c} as bigint) as value from steps"
    for g, names in RAW_GROUPS.items()
    for c in names
)


@query("a5_counters_map", f"select step_id, group_name, counter_name, value from ({COUNTER_ROWS})")
def _(t):
    return unpack.counter_values(raw_counters(t), "seq")


@query("p6_counter_rows", COUNTER_ROWS)
def _(t):
    maps = [
        part
        for g, names in RAW_GROUPS.items()
        for part in (F.lit(CLEAN[g]), F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("bigint"))]))
    ]
    return unpack.counter_rows(t.steps.select("flow_id", "step_id", F.create_map(*maps).alias("counters")))


@query("a9_clusters", "select distinct cluster_name from described", {"described": DESCRIBED})
def _(t):
    hosts = cluster.with_cluster(t.flows.select("jt_url").distinct(), CONFIG)
    return cluster.clusters(hosts.select(F.col("jt_url").alias("host"), "cluster_name"))


@query("a12_time_totals", "select flow_id, cast(sum(case when step_status = 'RUNNING' then 2 else step_running_time end) as bigint) "
    "as total_width from steps group by flow_id")
def _(t):
    return totals.time_totals(t.steps)


@query(
    "a13_combined_totals",
    "select flow_id, t_map_tasks + t_reduce_tasks as tasks, t_map_vcore_millis + t_reduce_vcore_millis as vcore_millis, "
    "t_hdfs_bytes_written + t_gs_bytes_written as bytes_written from totals",
)
def _(t):
    sums = totals.flow_totals(t.steps)
    return sums.select(
        "flow_id",
        totals.all_tasks("flow_total_map_tasks", "flow_total_reduce_tasks").alias("tasks"),
        totals.all_tasks("flow_map_vcore_millis", "flow_reduce_vcore_millis").alias("vcore_millis"),
        totals.all_tasks("flow_hdfs_bytes_written", "flow_gs_bytes_written").alias("bytes_written"),
    )


@query("a14_total_stages", "select flow_id, count(distinct step_number) as total_stages from step_updates group by flow_id")
def _(t):
    return totals.total_stages(t.step_updates)


@query(
    "t3_merge_maps",
    "select flow_id, coalesce(job_args, flow_status) as a, user_name as b, jt_url as c from flows",
)
def _(t):
    left = F.create_map(F.lit("a"), F.col("flow_status"), F.lit("b"), F.col("user_name"))
    right = F.when(F.col("job_args").isNull(), F.create_map(F.lit("c"), F.col("jt_url"))).otherwise(
        F.create_map(F.lit("a"), F.col("job_args"), F.lit("c"), F.col("jt_url"))
    )
    merged = t.flows.select("flow_id", totals.merge_maps(left, right).alias("m"))
    return merged.select("flow_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


JOB_DATE_SQL = """case o when 0 then 'Unknown' when 1 then 'None' when 2 then '2001-02-03'
    when 3 then '2001-02-03 - 2001-02-04' when 4 then '2001-02-03' else '2001-02-03' end"""
LISTING_SQL = f"""select flow_id, truncated_name as job_name, user_name, cluster_name, flow_status, total_stages,
    {JOB_DATE_SQL.replace('case o', 'case cast(flow_id as bigint) % 6')} as job_date,
    {duration_sql('flow_duration')} as running_time, {date_sql('flow_start_epoch_ms')} as start_time,
    {date_sql('flow_end_epoch_ms')} as end_time,
    case when flow_status = 'SUCCESSFUL' then 100.0::double else flow_progress end as progress, create_date
    from described left join progress using (flow_id)"""


@query("p5_job_listing", LISTING_SQL, {"described": DESCRIBED, "progress": PROGRESS_SQL})
def job_listing(t):
    flows = cluster.describe_flows(t.flows, CONFIG).join(totals.flow_progress(t.steps), "flow_id", "left")
    return newest_first(unpack.job_listing(flows, F.col("flow_progress")))


@query(
    "p5_running_listing",
    f"select * from ({LISTING_SQL}) where flow_status in ('RUNNING', 'SUBMITTED', 'STARTED')",
    {"described": DESCRIBED, "progress": PROGRESS_SQL},
)
def _(t):
    running = running_flows(t.flows, 0, 0)
    flows = cluster.describe_flows(running, CONFIG).join(
        totals.flow_progress(t.steps.join(running.select("flow_id"), "flow_id", "left_semi")), "flow_id", "left"
    )
    return unpack.job_listing(flows, F.col("flow_progress"))
