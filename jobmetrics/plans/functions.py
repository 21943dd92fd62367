"""Queries: scalar functions (X), unpacking and settings (P, J5, J6, J10, E, S9, S10)."""

from pyspark.sql import functions as F

from jobmetrics.functions import names, numbers, status, templates, times
from jobmetrics.operators import cluster, hooks, unpack
from jobmetrics.operators.select import running_steps
from jobmetrics.operators.totals import field_of
from jobmetrics.plans import settings as s
from jobmetrics.plans.registry import query
from jobmetrics.plans.settings import CONFIG, DESCRIBED
from jobmetrics.plans.tables import NOW
from jobmetrics.schemas import NULLABLE_COUNTERS, STEP_COUNTERS
from jobmetrics.sources.reports import public_config, to_report

C = F.col


@query(
    "x1_pretty_bytes",
    f"select step_id, {s.bytes_sql('hdfs_bytes_read')} as a, {s.bytes_sql('gs_bytes_read')} as b, "
    f"{s.bytes_sql('tuples_read')} as c, {s.bytes_sql('map_tasks * 8')} as d from steps",
)
def _(t):
    return t.steps.select(
        "step_id",
        numbers.pretty_bytes(C("hdfs_bytes_read")).alias("a"),
        numbers.pretty_bytes(C("gs_bytes_read")).alias("b"),
        numbers.pretty_bytes(C("tuples_read")).alias("c"),
        numbers.pretty_bytes(C("map_tasks") * 8).alias("d"),
    )


@query("x2_duration_text", f"select flow_id, {s.duration_sql('flow_duration')} as running_time from flows")
def _(t):
    return t.flows.select("flow_id", numbers.duration_text(C("flow_duration")).alias("running_time"))


@query(
    "x3_date_text",
    f"select flow_id, {s.date_sql('flow_start_epoch_ms')} as a, {s.date_sql('flow_end_epoch_ms')} as b from flows",
)
def _(t):
    return t.flows.select(
        "flow_id", times.date_text(C("flow_start_epoch_ms")).alias("a"), times.date_text(C("flow_end_epoch_ms")).alias("b")
    )


@query("x4_chart_label", f"select flow_id, epoch_ms, {s.utc_sql('epoch_ms', '%b %-d, %Y %H:%M:%S')} as label from agg")
def _(t):
    return t.agg.select("flow_id", "epoch_ms", times.chart_label(C("epoch_ms")).alias("label"))


@query(
    "x5_percent",
    "select step_id, cast(round(100.0 * step_running_time / 64, 2) as double) as pct, "
    "cast(0 as double) as nan_pct from steps",
)
def _(t):
    return t.steps.select(
        "step_id",
        numbers.percent(C("step_running_time") / 64).alias("pct"),
        numbers.percent(F.when(C("step_number") > 0, F.lit(float("nan")))).alias("nan_pct"),
    )


@query(
    "x6_flow_color",
    f"select flow_id, {s.FLOW_COLOR_SQL} as color, case when {s.FLOW_COLOR_SQL} = 'black' then 'white' else "
    f"{s.FLOW_COLOR_SQL} end as tip_color from flows",
)
def _(t):
    return t.flows.select(
        "flow_id", status.flow_color(C("flow_status")).alias("color"), status.flow_tip_color(C("flow_status")).alias("tip_color")
    )


@query("x7_x10_step_color", f"select step_id, {s.STEP_COLOR_SQL} as color, {s.MOOD_SQL} as mood from steps")
def _(t):
    return t.steps.select(
        "step_id", status.step_color(C("step_status")).alias("color"), status.mood(C("step_status")).alias("mood")
    )


@query("x8_size_class", f"select step_id, {s.size_class_sql('hdfs_bytes_read')} as a, {s.size_class_sql('gs_bytes_read')} as b from steps")
def _(t):
    return t.steps.select(
        "step_id", numbers.size_class(C("hdfs_bytes_read")).alias("a"), numbers.size_class(C("gs_bytes_read")).alias("b")
    )


@query(
    "x9_cycle_class",
    "select step_id, 'color-cycle-' || case step_status when 'RUNNING' then 'orange' when 'FAILED' then 'red' "
    "when 'SUCCESSFUL' then 'green' else 'grey' end || '-' || (step_number % 3 + 1) as color_class from steps",
)
def _(t):
    return t.steps.select("step_id", status.cycle_class(C("step_number"), C("step_status")).alias("color_class"))


@query(
    "x11_clean_group",
    "select step_id, 'mapreduce.Task' || step_number as a, 'com.org.apache.hadoop.x' as b from steps",
)
def _(t):
    nested = F.concat(
        F.when(C("step_number") % 2 == 0, "org.apache.hadoop.org.apache.hadoop.").otherwise("org.apache.hadoop."),
        F.lit("mapreduce.Task"),
        C("step_number").cast("string"),
        F.when(C("step_number") % 3 == 0, "$Inner$More").otherwise(""),
    )
    return t.steps.select(
        "step_id",
        names.clean_group(nested).alias("a"),
        names.clean_group(F.lit("com.org.apache.hadoop.x$y")).alias("b"),
    )


@query(
    "x12_without_prefix",
    "select flow_id, substr(flow_name, 13) as a, case when contains(flow_name, '1.1') then "
    "substr(flow_name, 1, instr(flow_name, '1.1') - 1) || substr(flow_name, instr(flow_name, '1.1') + 3) "
    "else flow_name end as b, flow_name as c from flows",
)
def _(t):
    name = C("flow_name")
    return t.flows.select(
        "flow_id",
        names.without_prefix(name, "com.example.").alias("a"),
        names.without_prefix(name, "1.1").alias("b"),
        names.without_prefix(name, "").alias("c"),
    )


@query("x13_user_link", "select flow_id, 'u/' || user_name || '/' || user_name as link, cast(null as varchar) as none from flows")
def _(t):
    return t.flows.select(
        "flow_id",
        names.user_link(C("user_name"), "u/${username}/${username}").alias("link"),
        names.user_link(C("user_name"), None).alias("none"),
    )


@query(
    "x14_x15_job_date",
    """select flow_id, case cast(flow_id as bigint) % 6 when 0 then 'Unknown' when 1 then 'None'
        when 3 then '2001-02-03 - 2001-02-04' else '2001-02-03' end as job_date,
        len(regexp_split_to_array(job_args, '\\s+')) as n_args from flows""",
)
def _(t):
    args = names.args_array(C("job_args"))
    return t.flows.select("flow_id", names.job_date(args).alias("job_date"), F.size(args).cast("bigint").alias("n_args"))


@query(
    "x16_host_port",
    "select flow_id, split_part(yarn_job_history, ':', 1) as host, case when contains(yarn_job_history, ':') then '10020' end "
    "as port, split_part(yarn_job_history, ':', 1) as manager from flows",
)
def _(t):
    address = C("yarn_job_history")
    return t.flows.select(
        "flow_id",
        names.host_of(address).alias("host"),
        names.port_of(address).alias("port"),
        names.manager_host(address).alias("manager"),
    )


PROPS_ORACLE = """select flow_id,
    case when c % 3 = 0 then 'UNKNOWN' when c % 3 = 1 then 'yarn' || c else 'jt' || c end as jt_url,
    case when c % 2 = 0 then 'user' || c else 'fallback' end as user_name,
    case when c % 5 = 0 then '/scratch' else '/tmp/cache' end as tmp_dir, 'false' as yarn_job_history,
    'UNKNOWN' as hdfs_working_dir, 'UNKNOWN' as flow_links, 'UNKNOWN' as cascade_id
    from (select flow_id, cast(flow_id as bigint) as c from flows)"""


@query("x17_x18_flow_defaults", PROPS_ORACLE)
def _(t):
    c = C("flow_id").cast("bigint")
    entry = lambda key, value: F.struct(F.lit(key).alias("k"), value.alias("v"))
    text = c.cast("string")
    props = F.array(
        F.when(c % 3 == 1, entry("yarn.resourcemanager.webapp.address", F.concat(F.lit("yarn"), text, F.lit(":8088")))),
        F.when(c % 3 != 0, entry("mapred.job.tracker", F.concat(F.lit("jt"), text, F.lit(":9001")))),
        F.when(c % 2 == 0, entry(unpack.TRACKER_PREFIX + "custom.user.name", F.concat(F.lit("user"), text))),
        F.when(c % 5 == 0, entry("hadoop.tmp.dir", F.lit("/scratch"))),
    )
    flows = t.flows.select("flow_id", F.lit(None).cast("string").alias("cascade_id"), F.map_from_entries(F.array_compact(props)).alias("config_props"))
    return unpack.flow_defaults(flows, "fallback").drop("config_props")


@query(
    "x19_repaired_duration",
    f"select flow_id, case when abs({NOW * 1000} - greatest(d, 0)) < 172800000 then 0 else greatest(d, 0) end as duration "
    "from (select flow_id, case cast(flow_id as bigint) % 3 when 0 then -flow_duration when 1 then flow_duration "
    "else update_date * 1000 end as d from flows)",
)
def _(t):
    c = C("flow_id").cast("bigint") % 3
    reported = F.when(c == 0, -C("flow_duration")).when(c == 1, C("flow_duration")).otherwise(C("update_date") * 1000)
    return t.flows.select("flow_id", numbers.repaired_duration(reported, NOW * 1000).alias("duration"))


def _radius_sql(c: str) -> str:
    return (
        f"case when {c} <= 50 then 5 when {c} <= 100 then 10 when {c} <= 500 then 20 when {c} <= 1000 then 30 "
        f"when {c} <= 5000 then 40 when {c} <= 10000 then 50 when {c} <= 50000 then 60 else 70 end"
    )


@query("x20_task_radius", f"select step_id, {_radius_sql('map_tasks')} as a, {_radius_sql('tuples_read')} as b from steps")
def _(t):
    return t.steps.select(
        "step_id", numbers.task_radius(C("map_tasks")).alias("a"), numbers.task_radius(C("tuples_read")).alias("b")
    )


@query("x21_groups", "select step_id, (step_number - 1) * 2 % 20 as m, ((step_number - 1) * 2 + 1) % 20 as r from steps")
def _(t):
    return t.steps.select("step_id", numbers.map_group(C("step_number")).alias("m"), numbers.reduce_group(C("step_number")).alias("r"))


@query(
    "x22_locality_percent",
    "select step_id, case when map_tasks > 0 then cast(floor(100 * (data_local_map_tasks / map_tasks) + 0.5) as bigint) end "
    "as pct from steps",
)
def _(t):
    return t.steps.select("step_id", numbers.locality_percent(C("data_local_map_tasks"), C("map_tasks")).alias("pct"))


@query(
    "x23_half_up",
    "select flow_id, epoch_ms, cast(floor(metric / 2 + 0.5) as bigint) as a, cast(floor(-metric / 2 + 0.5) as bigint) as b from agg",
)
def _(t):
    return t.agg.select(
        "flow_id", "epoch_ms", numbers.half_up(C("metric") / 2).alias("a"), numbers.half_up(-C("metric") / 2).alias("b")
    )


@query(
    "x24_templates",
    "select flow_id, user_name || '-' || flow_status || '-%{user}--%{open' as named, "
    "user_name || '/' || flow_status || '/100%/' as positional from flows",
)
def _(t):
    return t.flows.select(
        "flow_id",
        templates.fill_named(
            F.lit("%{user}-%{status}-`%{user}-%{missing}-%{open"), {"user": C("user_name"), "status": C("flow_status")}
        ).alias("named"),
        templates.fill_positional(F.lit("%/%/100`%/%"), [C("user_name"), C("flow_status")]).alias("positional"),
    )


@query(
    "x26_split_label",
    "select step_id, case when step_number % 3 = 0 then -1 else step_number end as stage, "
    "case when step_number % 3 = 0 then 'ERROR' else md5(step_id) end as id from steps",
)
def _(t):
    odd = F.when(C("step_number") % 6 == 0, F.concat(F.lit("x_"), C("step_id"))).otherwise(F.concat(F.lit("1_2_"), C("step_id")))
    label = F.when(C("step_number") % 3 == 0, odd).otherwise(
        F.concat(C("step_number").cast("string"), F.lit("_"), F.md5("step_id"))
    )
    return t.steps.select("step_id", names.split_label(label).alias("l")).select(
        "step_id", "l.stage", C("l.step_id").alias("id")
    )


@query("x27_path_or_unknown", "select flow_id, coalesce(tmp_dir, 'UNKNOWN') as path from flows")
def _(t):
    return t.flows.select("flow_id", names.path_or_unknown(C("tmp_dir")).alias("path"))


@query(
    "x28_bar_half",
    "select step_id, cast(floor(map_progress / 2 + 0.5) as bigint) as m, cast(floor(reduce_progress / 2 + 0.5) as bigint) as r from steps",
)
def _(t):
    return t.steps.select(
        "step_id", numbers.bar_half(C("map_progress")).alias("m"), numbers.bar_half(C("reduce_progress")).alias("r")
    )


@query("x29_status_text", "select step_id, 'Step ' || step_number || ': ' || step_status as txt from steps")
def _(t):
    return t.steps.select("step_id", status.status_text(C("step_number"), C("step_status")).alias("txt"))


@query("x30_dashed", "select flow_id, replace(flow_name, '.', '-') as dashed from flows")
def _(t):
    return t.flows.select("flow_id", names.dashed(C("flow_name")).alias("dashed"))


@query(
    "x31_application_id",
    "select step_id, substr(job_id, 5) as num, case when job_id = 'NO_JOB_ID' then job_id else 'application_' || substr(job_id, 5) "
    "end as app from steps",
)
def _(t):
    return t.steps.select(
        "step_id",
        names.application_number(C("job_id")).alias("num"),
        names.application_id(C("job_id")).alias("app"),
    )


# Unpacking.
@query(
    "p1_unpack_flows",
    "select flow_id, flow_name, create_date, update_date, 'DOC_' || flow_status as flow_status, jt_url, user_name, flow_duration, "
    "cluster_name, username_link, truncated_name, array_to_string(args, '|') as args, cast(flow_duration as double) as progress "
    "from described",
    {"described": DESCRIBED},
)
def _(t):
    doc = F.struct(
        F.lit("replaced by the key column").alias("flow_name"),
        F.concat(F.lit("DOC_"), C("flow_status")).alias("flow_status"),
        "jt_url",
        "user_name",
        "flow_duration",
        F.create_map(F.lit("flow_progress"), C("flow_duration").cast("double")).alias("aggregated"),
        F.create_map(F.lit(cluster.ARGS_KEY), C("job_args")).alias("config_props"),
    )
    stored = t.flows.select("flow_id", "flow_name", "flow_status", "create_date", "update_date", F.to_json(doc).alias("flow_json"))
    out = unpack.unpack_flows(stored, CONFIG)
    kept = ["flow_id", "flow_name", "create_date", "update_date", "flow_status", "jt_url", "user_name", "flow_duration"]
    return out.select(
        *kept,
        "cluster_name",
        "username_link",
        "truncated_name",
        F.array_join("args", "|").alias("args"),
        field_of(C("aggregated"), "flow_progress", "double").alias("progress"),
    )


def counters_struct(t):
    """Counter groups of a step as nested structs, null where a counter is missing."""
    groups = sorted({group for group, _ in STEP_COUNTERS.values()})
    return F.struct(
        *[
            F.struct(*[C(c).alias(key) for c, (group, key) in STEP_COUNTERS.items() if group == g]).alias(g)
            for g in groups
        ]
    )


def step_documents(t):
    """Steps as they are stored, with their document as text."""
    doc = F.struct(
        "step_number", "job_id", "step_id", "map_progress", "reduce_progress", "step_status", "step_running_time",
        "has_reduce_stage", counters_struct(t).alias("counters"),
        F.create_map(F.lit(unpack.DESCRIPTION_KEY), C("description")).alias("config_props"),
    )
    return t.steps.select(
        "flow_id", "step_id", F.to_json(doc).alias("step_json"), F.lit(1).cast("bigint").alias("create_date"),
        F.lit(2).cast("bigint").alias("update_date"),
    )


_PLAIN = [c for c in STEP_COUNTERS if c not in NULLABLE_COUNTERS]


@query(
    "p2_p3_unpack_steps",
    f"select flow_id, step_id, step_number, step_status, job_id, map_progress, {', '.join(_PLAIN)}, "
    "nullif(gs_bytes_read, 0) as gs_bytes_read, nullif(gs_bytes_written, 0) as gs_bytes_written, "
    f"{s.round_sql('map_vcore_millis / 1000')} as map_vcore_secs, {s.round_sql('reduce_vcore_millis / 1000')} as reduce_vcore_secs from steps",
)
def _(t):
    out = unpack.unpack_steps(step_documents(t))
    return out.select(
        "flow_id", "step_id", "step_number", "step_status", "job_id", "map_progress", *STEP_COUNTERS, "map_vcore_secs",
        "reduce_vcore_secs",
    )


@query(
    "p4_o4_steps_by_number",
    "select flow_id, step_number, step_id, step_status from step_updates "
    "qualify row_number() over (partition by flow_id, step_number order by arrived desc, seq_a desc, seq_b desc) = 1",
)
def _(t):
    kept = unpack.steps_by_number(t.step_updates, ["arrived", "seq_a", "seq_b"])
    return kept.select("flow_id", "step_number", "step_id", "step_status")


@query(
    "p7_e3_select_props",
    "select flow_id, flow_status as a, coalesce(job_args, 'UNKNOWN') as b, 'UNKNOWN' as c from flows",
)
def _(t):
    flows = t.flows.select(
        "flow_id",
        F.create_map(F.lit("x"), C("flow_status"), F.lit("y"), C("job_args"), F.lit("unused"), C("user_name")).alias("config_props"),
    )
    return unpack.select_props(flows, ["x", "y", "z"]).select(
        "flow_id", *[C("config_props")[k].alias(a) for k, a in (("x", "a"), ("y", "b"), ("z", "c"))]
    )


@query("p8_csv_list", "select p_partkey, p_brand || '|' || p_type as entries, 0 as n_empty from part")
def _(t):
    setting = F.concat(F.lit(" ,"), C("p_brand"), F.lit(" , ,  "), C("p_type"), F.lit(","))
    return t.raw("part").select(
        "p_partkey",
        F.array_join(names.csv_list(setting), "|").alias("entries"),
        F.size(names.csv_list(F.lit(None).cast("string"))).alias("n_empty"),
    )


@query("p12_has_reduce", "select step_id, reduce_tasks > 0 as has_reduce from steps")
def _(t):
    return t.steps.select("step_id", numbers.has_reduce(C("reduce_tasks")).alias("has_reduce"))


@query("p13_descriptions", "select step_id, coalesce(description, '') as description from steps")
def _(t):
    steps = t.steps.select("step_id", F.create_map(F.lit(unpack.DESCRIPTION_KEY), C("description")).alias("config_props"))
    return unpack.descriptions(steps).select("step_id", "description")


@query("p13_step_settings", "select step_id, coalesce(description, '') as description, extra_links from steps")
def _(t):
    keys = [F.lit(unpack.DESCRIPTION_KEY), C("description"), F.lit(unpack.TRACKER_PREFIX + unpack.LINKS_KEY), C("extra_links")]
    steps = t.steps.select("step_id", F.create_map(*keys).alias("config_props"))
    return unpack.step_settings(steps).select("step_id", "description", "extra_links")


@query("j5_with_cluster", "select flow_id, jt_url, cluster_name from described", {"described": DESCRIBED})
def _(t):
    return cluster.with_cluster(t.flows, CONFIG).select("flow_id", "jt_url", "cluster_name")


@query(
    "j5_cluster_table",
    f"select f.flow_id, coalesce(s.s_name, {s.RULE_NAME_SQL}) as cluster_name from flows f left join supplier s "
    "on 'rm' || (s.s_suppkey * 2) || '.example.com' = f.jt_url",
)
def _(t):
    hosts = t.raw("supplier").selectExpr(
        "'rm' || cast(s_suppkey * 2 as string) || '.example.com' as host", "s_name as cluster_name"
    )
    return cluster.with_cluster(t.flows, CONFIG, hosts).select("flow_id", "cluster_name")


@query("j6_regex_map", f"select flow_id, {s.RULE_NAME_SQL} as name from flows")
def _(t):
    mapped = templates.regex_map(C("jt_url"), CONFIG.cluster_name_regexes, F.lit("Unknown"))
    return t.flows.select("flow_id", mapped.alias("name"))


@query(
    "j10_with_start",
    f"select s.step_id, coalesce(cast(floor(({NOW * 1000} - u.start_ms) / 1000) as bigint), s.step_running_time) as step_running_time "
    "from steps s left join (select step_id, max(arrived) * 1000 + 7 as start_ms from step_updates "
    "where step_status = 'RUNNING' group by step_id) u using (step_id)",
)
def _(t):
    starts = t.step_updates.filter("step_status = 'RUNNING'").select("step_id", (C("arrived") * 1000 + 7).alias("start_ms"))
    return unpack.with_start(t.steps, starts, NOW * 1000).select("step_id", "step_running_time")


@query("e2_e4_hooks", "select step_id, step_running_time * 2 as twice from steps where step_status = 'RUNNING'")
def _(t):
    both = hooks.chain(running_steps, None, lambda df: df.selectExpr("step_id", "step_running_time * 2 as twice"))
    return hooks.extract(t.steps, both)


@query("e5_custom_user", "select flow_id, case when cast(flow_id as bigint) % 2 = 0 then 'custom' || flow_id else 'nobody' end as user_name from flows")
def _(t):
    custom = F.when(C("flow_id").cast("bigint") % 2 == 0, F.concat(F.lit("custom"), C("flow_id")))
    props = F.create_map(F.lit("own.custom.user.name"), custom).alias("config_props")
    flows = t.flows.select("flow_id", props, F.lit(None).cast("string").alias("cascade_id"))
    return unpack.flow_defaults(flows, "nobody", prefix="own.").select("flow_id", "user_name")


@query(
    "s9_to_report",
    """select step_id, '{"step_id":"' || step_id || '","step_number":' || step_number || ',"gs_bytes_read":' ||
        coalesce(cast(gs_bytes_read as varchar), 'null') || ',"has_reduce_stage":' || has_reduce_stage || '}' as report from steps""",
)
def _(t):
    return to_report(t.steps, ["step_id", "step_number", "gs_bytes_read", "has_reduce_stage"]).select("step_id", "report")


@query(
    "s10_public_config",
    """select s_suppkey, k as key, case when k in ('user', 'password', 'host', 'flow_table_alias') then '' else s_name end as value
        from supplier, (values ('user'), ('password'), ('host'), ('flow_table_alias'), ('job_name_prefix')) v(k)""",
)
def _(t):
    keys = F.array(*[F.lit(k) for k in ("user", "password", "host", "flow_table_alias", "job_name_prefix")])
    rows = t.raw("supplier").select("s_suppkey", F.explode(keys).alias("key"), C("s_name").alias("value"))
    return public_config(rows)
