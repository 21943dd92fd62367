"""Queries: state-keeping writes (U, R3, R4, R5, R6) in batch form."""

from pyspark.sql import functions as F

from jobmetrics.operators import state
from jobmetrics.plans.registry import query
from jobmetrics.plans.tables import ARRIVAL
from jobmetrics.runtime import scratch_path
from jobmetrics.sources import buckets

# The first half of the updates is the current table, the second half arrives.
SPLIT = 883612800  # 1998-01-01 00:00:00 UTC

STEP_STATE = "flow_id, step_id, step_status, map_progress, update_date, create_date"


def dated_steps(t):
    columns = ["flow_id", "step_id", "step_status", "map_progress", F.col("arrived").alias("update_date"), *ARRIVAL]
    return t.step_updates.select(*columns)


STEP_STATE_SQL = """select flow_id, step_id, step_status, map_progress, arrived as update_date, first_arrived as create_date
    from (select *, first_value(arrived) over (partition by step_id order by arrived, seq_a, seq_b) as first_arrived,
        row_number() over (partition by step_id order by arrived desc, seq_a desc, seq_b desc) as rn from step_updates)
    where rn = 1"""


@query("u3_upsert_steps", STEP_STATE_SQL)
def _(t):
    updates = dated_steps(t)
    old = state.collapse(updates.filter(F.col("arrived") < SPLIT), ["step_id"], ARRIVAL).drop(*ARRIVAL)
    return state.upsert_steps(old, updates.filter(F.col("arrived") >= SPLIT), ARRIVAL).select(*STEP_STATE.split(", "))


def bucketed(df, name: str, schema: str, keys: list[str]) -> buckets.BucketedTable:
    """An empty table in the shared folder."""
    return buckets.BucketedTable(df.sparkSession, scratch_path(df.sparkSession, name), schema, keys, 8)


@query("u3_bucketed_steps", STEP_STATE_SQL)
def _(t):
    updates = dated_steps(t)
    schema = "flow_id string, step_id string, step_status string, map_progress double, update_date bigint, create_date bigint"
    table = bucketed(updates, "steps", schema, ["step_id"])
    for part in (F.col("arrived") < SPLIT, F.col("arrived") >= SPLIT):
        buckets.upsert(table, updates.filter(part), ARRIVAL)
    return table.read()


# One report of a flow for each of its step updates. Old clients send no aggregates.
FLOW_UPDATES = """select flow_id, 'run ' || cast(step_number as string) as flow_name, step_status as flow_status,
    case when step_status = 'SUBMITTED' then null else map_progress end as aggregated, arrived as update_date, arrived, seq_a, seq_b,
    step_number from step_updates"""
FLOW_ORDER = [*ARRIVAL, "step_number"]


def flow_updates(t):
    return t.step_updates.select(
        "flow_id",
        F.concat(F.lit("run "), F.col("step_number").cast("string")).alias("flow_name"),
        F.col("step_status").alias("flow_status"),
        F.when(F.col("step_status") == "SUBMITTED", None).otherwise(F.col("map_progress")).alias("aggregated"),
        F.col("arrived").alias("update_date"),
        *FLOW_ORDER,
    )


U1_SQL = """select flow_id, flow_name, flow_status, aggregated, update_date, first_arrived as create_date from (select *,
        first_value(arrived) over (partition by flow_id order by arrived, seq_a, seq_b, step_number) as first_arrived,
        row_number() over (partition by flow_id order by arrived desc, seq_a desc, seq_b desc, step_number desc) as rn
        from flow_updates where aggregated is not null) where rn = 1"""


@query("u1_upsert_flows", U1_SQL, {"flow_updates": FLOW_UPDATES})
def _(t):
    updates = state.has_aggregated(flow_updates(t))
    old = state.collapse(updates.filter(F.col("arrived") < SPLIT), ["flow_id"], FLOW_ORDER).drop(*FLOW_ORDER)
    new = updates.filter(F.col("arrived") >= SPLIT)
    out = state.upsert_flows(old, new, FLOW_ORDER)
    return out.select("flow_id", "flow_name", "flow_status", "aggregated", "update_date", "create_date")


@query("u1_bucketed_flows", U1_SQL, {"flow_updates": FLOW_UPDATES})
def _(t):
    updates = state.has_aggregated(flow_updates(t))
    schema = "flow_id string, flow_name string, flow_status string, aggregated double, update_date bigint, create_date bigint"
    table = bucketed(updates, "flows", schema, ["flow_id"])
    for part in (F.col("arrived") < SPLIT, F.col("arrived") >= SPLIT):
        buckets.upsert(table, updates.filter(part), FLOW_ORDER)
    return table.read()


@query(
    "u2_has_aggregated",
    "select flow_id, flow_name, aggregated from flow_updates where aggregated is not null",
    {"flow_updates": FLOW_UPDATES},
)
def _(t):
    return state.has_aggregated(flow_updates(t)).select("flow_id", "flow_name", "aggregated")


EDGE_UPDATES = """select flow_id, step_number - 1 as src_stage, step_number as dest_stage, arrived as update_date, arrived,
    seq_a, seq_b from step_updates where step_number > 1"""


def edge_updates(t):
    return t.step_updates.filter("step_number > 1").select(
        "flow_id",
        (F.col("step_number") - 1).alias("src_stage"),
        F.col("step_number").alias("dest_stage"),
        F.col("arrived").alias("update_date"),
        F.col("arrived").alias("create_date"),
        *ARRIVAL,
    )


U4_SQL = (
    "select flow_id, src_stage, dest_stage, update_date, update_date as create_date from edge_updates "
    "qualify row_number() over (partition by flow_id, src_stage, dest_stage order by arrived, seq_a, seq_b) = 1"
)


@query("u4_insert_edges", U4_SQL, {"edge_updates": EDGE_UPDATES})
def _(t):
    updates = edge_updates(t)
    empty = updates.filter(F.lit(False)).drop(*ARRIVAL)
    old = state.insert_edges(empty, updates.filter(F.col("arrived") < SPLIT), ARRIVAL)
    return state.insert_edges(old, updates.filter(F.col("arrived") >= SPLIT), ARRIVAL)


@query("u4_bucketed_edges", U4_SQL, {"edge_updates": EDGE_UPDATES})
def _(t):
    updates = edge_updates(t)
    schema = "flow_id string, src_stage int, dest_stage int, update_date bigint, create_date bigint"
    table = bucketed(updates, "edges", schema, state.EDGE_KEYS)
    for part in (F.col("arrived") < SPLIT, F.col("arrived") >= SPLIT):
        buckets.insert_edges(table, updates.filter(part), ARRIVAL)
    return table.read()


# Snapshots arrive by the minute here, so some keys are written more than once.
AGG_UPDATES = "select flow_id, epoch_ms // 60000 * 60000 as epoch_ms, metric, payload, seq, epoch_ms as at_ms from agg"


def agg_updates(t):
    minute = (F.floor(F.col("epoch_ms") / 60000) * 60000).cast("bigint")
    return t.agg.select("flow_id", minute.alias("epoch_ms"), "metric", "payload", "seq", F.col("epoch_ms").alias("at_ms"))


U5_SQL = (
    "select flow_id, epoch_ms, metric, payload from agg_updates "
    "qualify row_number() over (partition by flow_id, epoch_ms order by at_ms desc, seq desc) = 1"
)


@query("u5_upsert_agg", U5_SQL, {"agg_updates": AGG_UPDATES})
def _(t):
    updates = agg_updates(t)
    half = F.col("at_ms") < 1705000000000
    empty = updates.filter(F.lit(False)).select("epoch_ms", "flow_id", "metric", "payload")
    old = state.upsert_agg(empty, updates.filter(half), ["at_ms", "seq"])
    return state.upsert_agg(old, updates.filter(~half), ["at_ms", "seq"])


@query("u5_bucketed_agg", U5_SQL, {"agg_updates": AGG_UPDATES})
def _(t):
    updates = agg_updates(t)
    half = F.col("at_ms") < 1705000000000
    table = bucketed(updates, "snapshots", "epoch_ms bigint, flow_id string, metric double, payload string", state.AGG_KEYS)
    for part in (half, ~half):
        buckets.upsert_agg(table, updates.filter(part), ["at_ms", "seq"])
    return table.read()


CHANGED_SQL = """select step_id, step_status, previous_status, arrived, seq_a, seq_b from (select *, lag(step_status) over
    (partition by step_id order by arrived, seq_a, seq_b) as previous_status from step_updates)
    where previous_status is null or step_status = 'RUNNING' or step_status <> previous_status"""
CHANGED = ["step_id", "step_status", "previous_status", *ARRIVAL]


@query("u6_changed_steps", CHANGED_SQL)
def _(t):
    month = F.floor(F.col("arrived") / (30 * 86400)).alias("month")
    updates = t.step_updates.select("step_id", "step_status", *ARRIVAL, month)
    return state.changed_steps(updates, ARRIVAL, "month").select(*CHANGED)
