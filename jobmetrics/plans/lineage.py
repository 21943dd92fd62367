"""Queries: lineage, edge labels, links, run detail (J1, J3, J7, L, P9, P14, G9, S11, T1)."""

from pyspark.sql import functions as F

from jobmetrics.operators import detail, lineage, links
from jobmetrics.operators.cluster import describe_flows
from jobmetrics.plans.registry import query
from jobmetrics.plans.settings import CONFIG, DESCRIBED, HISTORY_RULE, MOOD_SQL, STEP_COLOR_SQL, bytes_sql, size_class_sql
from jobmetrics.sources.reports import edge_report


@query("j1_lineage_edges", "select * from edges")
def _(t):
    return lineage.lineage_edges(t.taps)


LABELLED = f"""select e.flow_id, e.src_stage, e.dest_stage, s.hdfs_bytes_written + coalesce(s.gs_bytes_written, 0) as bytes_written,
    {bytes_sql('(s.hdfs_bytes_written + coalesce(s.gs_bytes_written, 0))')} as label,
    {size_class_sql('s.hdfs_bytes_written')} as label_class
    from edges e join steps s on s.flow_id = e.flow_id and s.step_number = e.src_stage"""


@query("j3_l1_labelled_edges", LABELLED)
def _(t):
    return lineage.labelled_edges(t.edges, t.steps)


@query(
    "j7_flow_detail",
    """select p.*, f.flow_name, f.flow_status from (
        select flow_id, 'flow' as part, null::int as step_number, null::int as dest_stage, null as step_status, null as label
        from flows union all
        select flow_id, 'step', step_number, null, step_status, null from steps union all
        select flow_id, 'edge', src_stage, dest_stage, null, label from labelled) p join flows f using (flow_id)""",
    {"labelled": LABELLED},
)
def _(t):
    return detail.flow_detail(t.flows, t.steps, t.edges)


@query(
    "g9_graph_rows",
    f"""select flow_id, 'vertex' as kind, step_number as src_stage, null::int as dest_stage, coalesce(description, '') as label,
        {STEP_COLOR_SQL} as color, {MOOD_SQL} as mood from steps
    union all select flow_id, 'edge', src_stage, dest_stage, label, label_class, null from labelled""",
    {"labelled": LABELLED},
)
def _(t):
    return lineage.graph_rows(t.edges, t.steps)


@query(
    "l2_a7_a8_f17_flow_io",
    """select distinct flow_id, case when direction = 'sink' then 'output' else 'input' end as direction, path
    from taps join flows using (flow_id) where tmp_dir is null or not starts_with(path, tmp_dir)""",
)
def _(t):
    return lineage.flow_io(t.taps, t.flows)


FIELDS_SQL = "'id, f' || step_number"


def tapped_steps(t):
    steps = t.step_keys.withColumn("step_id", F.expr("flow_id || '-' || cast(step_number as string)"))
    return lineage.with_taps(steps, t.taps.select("step_id", "direction", "path", "fields"))


@query("p9_p14_tap_rows", f"select flow_id, step_id, step_number, direction, path, {FIELDS_SQL} as fields from taps")
def _(t):
    """Each tap as the report of its step gives it, in a map of paths to field names."""

    def side(name):
        none = F.from_json(F.lit("{}"), "map<string,array<string>>")
        return F.when(F.col("direction") == name, F.create_map("path", "fields")).otherwise(none)

    reported = tapped_steps(t).filter("path is not null")
    return lineage.tap_rows(reported.select("flow_id", "step_id", "step_number", side("source").alias("sources"), side("sink").alias("sink")))


@query(
    "p14_with_taps",
    "select step_id, direction, path, fields from (select step_id, direction, path, "
    f"{FIELDS_SQL} as fields from taps) union all select flow_id || '-' || step_number, null, null, null from steps "
    "where (flow_id, step_number) not in (select (flow_id, step_number) from taps)",
)
def _(t):
    return tapped_steps(t).select("step_id", "direction", "path", F.translate(F.array_join("fields", ", "), "'", "").alias("fields"))


@query(
    "p14_flat_taps",
    "select step_id, path from taps where direction = 'source' and step_number % 5 <> 0 union all "
    "select step_id, path || x from taps, (values ('/a'), ('/b')) v(x) where direction = 'source' and step_number % 5 = 0",
)
def _(t):
    children = F.when(
        F.col("step_number") % 5 == 0, F.array(F.concat("path", F.lit("/a")), F.concat("path", F.lit("/b")))
    )
    sources = t.taps.filter("direction = 'source'").withColumn("children", children)
    return lineage.flat_taps(sources).select("step_id", "path")


@query(
    "s11_a10_edge_report",
    """select flow_id, src_stage, dest_stage, '{"' || src_stage || '":[' || dest_stage || ']}' as report from edges""",
)
def _(t):
    return edge_report(t.edges)


@query(
    "t1_all_edges",
    "select distinct flow_id, step_number as src_stage, step_number + 1 as dest_stage from steps union select * from edges",
)
def _(t):
    planned = t.step_keys.selectExpr("flow_id", "step_number as src_stage", "step_number + 1 as dest_stage")
    return lineage.all_edges(planned, t.edges)


# Links.
def host_sql(host: str) -> str:
    part = lambda n: f"regexp_extract({host}, '{HISTORY_RULE}', {n})"
    return f"case when regexp_matches({host}, '{HISTORY_RULE}') then 'history-' || {part(1)} || '.' || {part(2)} else {host} end"


_HIST = f"({host_sql(chr(39) + 'X' + chr(39))})".replace("'X'", "split_part(yarn_job_history, ':', 1)")
_RM = "split_part(jt_url, ':', 1)"
_DONE = "step_status in ('SUCCESSFUL', 'FAILED', 'SKIPPED', 'STOPPED')"
_YARN = "job_id <> 'NO_JOB_ID' and yarn_job_history <> 'false'"
_USER_JOB = "user_name || '/' || replace(truncated_name, '.', '-') || '/' || flow_id"
JOINED = "select s.*, d.* exclude (flow_id) from steps s join described d using (flow_id)"
STEP_LINKS = f"""
    select flow_id, step_number, flow_status, 'View Hadoop Logs' as name, '//' || {_HIST} || case when {_DONE}
        then ':19888/jobhistory/job/job_' else ':8088/proxy/application_' end || substr(job_id, 5) as url from joined where {_YARN}
    union all select flow_id, step_number, flow_status, 'Failed Map Tasks', '//' || {_HIST} || ':19888/jobhistory/attempts/' || job_id
        || '/m/FAILED' from joined where {_YARN} and step_status = 'FAILED' and failed_map_tasks > 0
    union all select flow_id, step_number, flow_status, 'Failed Reduce Tasks', '//' || {_HIST} || ':19888/jobhistory/attempts/' || job_id
        || '/r/FAILED' from joined where {_YARN} and step_status = 'FAILED' and failed_reduce_tasks > 0
    union all select flow_id, step_number, flow_status, 'ApplicationMaster', '//' || {_RM} || ':8088/cluster/app/application_'
        || substr(job_id, 5) from joined where {_YARN}
    union all select flow_id, step_number, flow_status, 'View Hadoop Logs', 'http://' || {_RM} || ':50030/jobdetails.jsp?jobid='
        || job_id || '&refresh=0' from joined where job_id <> 'NO_JOB_ID' and yarn_job_history = 'false'
    union all select flow_id, step_number, flow_status, 'Step Log', '//s.example.com/' || flow_id || '/' || step_number || '?u='
        || user_name || '&m=' from joined where extra_links is not null"""
FLOW_LINKS = f"""select flow_id, 'Client Logs' as name, '//logs.example.com/' || {_USER_JOB} as url from described
        where flow_links is not null
    union all select flow_id, 'Done`% Rate', '//x.example.com/%' from described where flow_links is not null"""
_CTES = {"described": DESCRIBED, "joined": JOINED, "step_link_rows": STEP_LINKS, "flow_link_rows": FLOW_LINKS}


@query("l3_step_links", "select * from step_link_rows", _CTES)
def _(t):
    return links.step_links(t.steps, describe_flows(t.flows, CONFIG), CONFIG)


@query("l3_flow_links", "select * from flow_link_rows", _CTES)
def _(t):
    return links.flow_links(describe_flows(t.flows, CONFIG))


@query(
    "l4_failure_links",
    """select flow_id, name || ' for Step ' || step_number as name, url from step_link_rows
        where name like 'Failed%' and flow_status in ('FAILED', 'STOPPED')
    union all select l.flow_id, l.name, l.url from flow_link_rows l join flows f using (flow_id)
        where l.name = 'Client Logs' and f.flow_status in ('FAILED', 'STOPPED') and l.flow_id not in
        (select flow_id from step_link_rows where name like 'Failed%')""",
    _CTES,
)
def _(t):
    return links.failure_links(t.steps, describe_flows(t.flows, CONFIG), CONFIG)
