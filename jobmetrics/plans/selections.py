"""Queries: filters, lookups, listing order (F, O)."""

from pyspark.sql import functions as F

from jobmetrics.functions import status as st
from jobmetrics.functions.names import valid_flow_id
from jobmetrics.operators import select as sel
from jobmetrics.operators import words as wd
from jobmetrics.operators.cluster import describe_flows
from jobmetrics.plans.registry import query
from jobmetrics.plans.settings import CONFIG, DESCRIBED
from jobmetrics.plans.tables import DAYS_30, NOW

BASE = ["flow_id", "flow_name", "flow_status", "create_date", "update_date"]
BASE_SQL = ", ".join(BASE)
JOB = "com.example.jobs.1-URGENT.7"
AGG_FROM, AGG_TO = 1704067200000, 1705276800000


@query(
    "f1_running_flows",
    f"select {BASE_SQL} from flows where update_date > {NOW - DAYS_30} and flow_status in ('RUNNING', 'SUBMITTED', 'STARTED')",
)
def _(t):
    return sel.running_flows(t.flows, NOW, DAYS_30).select(*BASE)


@query(
    "f2_completed_flows",
    f"select {BASE_SQL} from flows where update_date > {NOW - 3000 * 86400} "
    "and flow_status in ('STOPPED', 'FAILED', 'SUCCESSFUL', 'SKIPPED')",
)
def _(t):
    return sel.completed_flows(t.flows, NOW, 3000 * 86400).select(*BASE)


@query("f3_completed_flow_ids", "select flow_id from flows where flow_status in ('STOPPED', 'FAILED', 'SUCCESSFUL', 'SKIPPED')")
def _(t):
    return sel.completed_flow_ids(t.flows)


@query(
    "f4_all_completed",
    f"select {BASE_SQL} from flows where flow_status in ('STOPPED', 'FAILED', 'SUCCESSFUL', 'SKIPPED')",
)
def _(t):
    return sel.all_completed(t.flows).select(*BASE)


@query(
    "f5_search_flows",
    f"select {BASE_SQL} from flows where flow_name ilike '%jobs%urgent%1%' order by create_date desc, flow_id limit 40",
)
def _(t):
    return sel.search_flows(t.flows, "%20JOBS+urgent  1").select(*BASE)


@query(
    "f6_flow_history",
    f"select {BASE_SQL} from flows where flow_name = '{JOB}' and flow_status in ('STOPPED', 'FAILED', 'SUCCESSFUL') "
    "order by create_date desc, flow_id limit 40",
)
def _(t):
    return sel.flow_history(t.flows, JOB).select(*BASE)


@query(
    "f6_all_histories",
    f"select {BASE_SQL} from flows where flow_status in ('STOPPED', 'FAILED', 'SUCCESSFUL') "
    "qualify row_number() over (partition by flow_name order by create_date desc, flow_id) <= 40",
)
def _(t):
    return sel.all_histories(t.flows).select(*BASE)


@query(
    "f7_steps_of",
    "select flow_id, step_id, step_number, step_status from steps "
    "where flow_id in (select flow_id from flows where flow_status = 'FAILED')",
)
def _(t):
    failed = t.flows.filter("flow_status = 'FAILED'")
    return sel.steps_of(t.steps, failed).select("flow_id", "step_id", "step_number", "step_status")


@query("f8_flow_by_id", f"select {BASE_SQL} from flows where flow_id = '7'")
def _(t):
    return sel.flow_by_id(t.flows, "7").select(*BASE)


@query("f9_steps_by_flow", "select flow_id, step_id, step_number, step_status from steps where flow_id = '7'")
def _(t):
    return sel.steps_by_flow(t.steps, "7").select("flow_id", "step_id", "step_number", "step_status")


@query("f10_edges_by_flow", "select * from edges where flow_id = '7'")
def _(t):
    return sel.edges_by_flow(t.edges, "7")


@query("f11_agg_by_flow", "select flow_id, epoch_ms, metric, payload from agg where flow_id = '7'")
def _(t):
    return sel.agg_by_flow(t.agg, "7").select("flow_id", "epoch_ms", "metric", "payload")


@query(
    "f12_agg_between",
    f"select flow_id, epoch_ms, metric, payload from agg where epoch_ms >= {AGG_FROM} and epoch_ms <= {AGG_TO}",
)
def _(t):
    return sel.agg_between(t.agg, AGG_FROM, AGG_TO).select("flow_id", "epoch_ms", "metric", "payload")


@query(
    "f13_by_cluster",
    f"select {BASE_SQL}, cluster_name from described where cluster_name = 'Alpha'",
    {"described": DESCRIBED},
)
def _(t):
    return sel.by_cluster(describe_flows(t.flows, CONFIG), "Alpha").select(*BASE, "cluster_name")


@query(
    "f14_by_cluster_ci",
    f"select {BASE_SQL}, cluster_name from described where lower(cluster_name) = 'cluster-3'",
    {"described": DESCRIBED},
)
def _(t):
    return sel.by_cluster_ci(describe_flows(t.flows, CONFIG), "CLUSTER-3").select(*BASE, "cluster_name")


@query("f15_running_steps", "select flow_id, step_id, map_progress from steps where step_status = 'RUNNING'")
def _(t):
    return sel.running_steps(t.steps).select("flow_id", "step_id", "map_progress")


WORDS = """select word, count(*) as n from (select unnest(regexp_split_to_array(
    regexp_replace(lower(line), '[^a-z0-9\\s]', '', 'g'), '\\s+')) as word from lines) group by word"""


@query("f16_by_initial", "select word, n, 'vowel' as initial from words where regexp_matches(word, '^[aeiou]') "
    "union all select word, n, 'other' from words where regexp_matches(word, '^[^aeiou]')", {"words": WORDS})
def _(t):
    counts = wd.word_count(t.lines).withColumnRenamed("count", "n")
    return sel.with_initial(counts, {"vowel": wd.VOWEL, "other": wd.OTHER})


@query(
    "f19_is_finished",
    "select flow_id, flow_status, flow_status in ('FAILED', 'STOPPED', 'SUCCESSFUL') as finished from flows",
)
def _(t):
    return t.flows.select("flow_id", "flow_status", st.is_finished(F.col("flow_status")).alias("finished"))


@query(
    "f20_is_failing",
    "select flow_id, flow_status from flows where flow_status not in "
    "('RUNNING', 'SUBMITTED', 'SUCCESSFUL', 'PENDING', 'STARTED', 'SKIPPED')",
)
def _(t):
    return t.flows.filter(st.is_failing(F.col("flow_status"))).select("flow_id", "flow_status")


@query(
    "f21_valid_flow_id",
    "select candidate, regexp_full_match(candidate, '[A-Fa-f0-9]+') as valid from (select step_id as candidate from steps "
    "union all select flow_id from flows union all select hex(o_orderkey) from orders)",
)
def _(t):
    ids = (
        t.steps.selectExpr("step_id as candidate")
        .unionByName(t.flows.selectExpr("flow_id as candidate"))
        .unionByName(t.raw("orders").selectExpr("hex(o_orderkey) as candidate"))
    )
    return ids.withColumn("valid", valid_flow_id(F.col("candidate")))


@query("o1_newest_first", f"select {BASE_SQL} from flows")
def _(t):
    return sel.newest_first(t.flows).select(*BASE)


@query("o2_newest_40", f"select {BASE_SQL} from flows order by create_date desc, flow_id limit 40")
def _(t):
    return sel.newest_first(t.flows).limit(sel.RESULT_LIMIT).select(*BASE)


@query("o3_rarest_words", "select word, n from words where regexp_matches(word, '^[^aeiou]') order by n, word limit 20", {"words": WORDS})
def _(t):
    return wd.rarest(wd.word_count(t.lines), wd.OTHER, "word", "count").withColumnRenamed("count", "n")
