"""Workflow tables derived from the given parquet tables, for the registered queries.

Every derived column is one SQL expression that means the same in Spark and in DuckDB, so the tables are
declared once: as a DataFrame here and as a common table expression for the check SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmetrics.operators.lineage import lineage_edges
from jobmetrics.operators.skew import latest_per_key

NOW = 996710400  # 2001-08-02 00:00:00 UTC
DAYS_30 = 30 * 86400

FLOW_COLUMNS = {
    "flow_id": "cast(o_orderkey as string)",
    "flow_name": "'com.example.jobs.' || o_orderpriority || '.' || cast(o_custkey % 50 as string)",
    "flow_status": """case when o_orderstatus = 'F' then
            case o_orderkey % 5 when 0 then 'FAILED' when 1 then 'STOPPED' when 2 then 'SKIPPED' else 'SUCCESSFUL' end
        when o_orderstatus = 'O' then case o_orderkey % 3 when 0 then 'RUNNING' when 1 then 'SUBMITTED' else 'STARTED' end
        else 'PENDING' end""",
    "create_date": "order_epoch",
    "update_date": "order_epoch + o_orderkey % 86400",
    "flow_duration": "cast(round(o_totalprice * 100) as bigint)",
    "user_name": "'user' || cast(o_custkey % 20 as string)",
    "jt_url": "'rm' || cast(o_custkey % 7 as string) || '.example.com'",
    "total_stages": "cast(o_custkey % 9 as int)",
    "flow_priority": "cast(o_orderkey % 4 as int)",
    "yarn_job_history": "case when o_custkey % 3 = 0 then 'false' "
    "else 'jh' || cast(o_custkey % 7 as string) || '.example.com:10020' end",
    "tmp_dir": "case when o_custkey % 11 = 0 then null else '/tmp/u' || cast(o_custkey % 4 as string) end",
    "flow_links": "case when o_custkey % 6 = 0 then null "
    "else 'Client+Logs|logs.example.com/%{user}/%{job_name}/%{flow_id};lonely;Done`%+Rate|x.example.com/`%%{stage}' end",
    "flow_start_epoch_ms": "order_epoch * 1000 + 1500",
    "flow_submit_epoch_ms": "order_epoch * 1000",
    "flow_end_epoch_ms": "case when o_orderstatus = 'F' "
    "then order_epoch * 1000 + cast(round(o_totalprice * 100) as bigint) else 0 end",
    "job_args": """case o_orderkey % 6 when 0 then null when 1 then '--input /in'
        when 2 then '--date 2001_02_03 --input  /in' when 3 then '--hdfs --date 2001_02_03 2001_02_04'
        when 4 then '--date 2001_02_03 2001_02_04 --daily' else '--input /in --date 2001_02_03' end""",
}

_P = "cast(floor(l_extendedprice) as bigint)"
_MAPS = "(l_partkey % 400)"
_REDUCES = "(l_suppkey % 60)"

STEP_COLUMNS = {
    "flow_id": "cast(l_orderkey as string)",
    "step_number": "l_linenumber",
    "step_id": "cast(l_orderkey as string) || '-' || cast(l_linenumber as string)",
    "arrived": "ship_epoch",
    "seq_a": "l_partkey",
    "seq_b": "l_suppkey",
    "step_status": """case when l_returnflag = 'R' then 'FAILED' when l_linestatus = 'F' then 'SUCCESSFUL'
        when l_partkey % 10 = 0 then 'SUBMITTED' when l_partkey % 10 = 1 then 'NOT_LAUNCHED' else 'RUNNING' end""",
    "job_id": "case when l_partkey % 13 = 0 then 'NO_JOB_ID' "
    "else 'job_' || cast(l_orderkey as string) || '_' || lpad(cast(l_linenumber as string), 4, '0') end",
    "map_progress": "l_quantity * 2",
    "reduce_progress": "round(l_tax * 1000, 2)",
    "has_reduce_stage": "l_suppkey % 2 = 0",
    "step_running_time": "cast(floor(l_quantity) as bigint)",
    "step_priority": "5",
    "step_start_epoch_ms": "ship_epoch * 1000",
    "description": "case when l_partkey % 4 = 0 then null else 'load part ' || cast(l_partkey as string) end",
    "extra_links": "case when l_partkey % 5 = 0 then null "
    "else 'Step+Log|s.example.com/%{flow_id}/%{stage}?u=%{user}&m=%{missing};broken;a|b|c' end",
    "map_tasks": _MAPS,
    "reduce_tasks": _REDUCES,
    "failed_map_tasks": "case when l_returnflag = 'R' then l_partkey % 3 else 0 end",
    "failed_reduce_tasks": "case when l_returnflag = 'R' then l_suppkey % 2 else 0 end",
    "data_local_map_tasks": f"cast(floor({_MAPS} / 2) as bigint)",
    "rack_local_map_tasks": f"cast(floor({_MAPS} / 4) as bigint)",
    "map_vcore_millis": f"{_P} * 7",
    "reduce_vcore_millis": f"{_P} * 5",
    "hdfs_bytes_read": "l_partkey % 100000000 * 10000000000",
    "hdfs_bytes_written": f"{_P} * 100000000",
    "gs_bytes_read": f"case when l_linenumber % 2 = 0 then null else {_P} * 10000000 end",
    "gs_bytes_written": f"case when l_linenumber % 2 = 0 then null else {_P} * 20000000 end",
    "file_bytes_read": f"{_P} * 1000000",
    "file_bytes_written": "l_suppkey % 100000000 * 5000000000",
    "tuples_read": f"{_P} * 12",
    "tuples_written": f"{_P} * 6",
    "io_read_millis": f"{_P}",
    "io_write_millis": f"{_P} * 3",
    "cpu_millis": f"{_P} * 7",
    "gc_millis": f"{_P} * 5",
    "shuffled_maps": f"{_MAPS} * {_REDUCES}",
    "map_records_out": f"{_P} * 11",
    "reduce_records_in": f"{_P} * 10",
    "reduce_records_out": f"{_P} * 9",
    "map_bytes_out": f"{_P} * 1000",
    "merged_map_outputs": f"{_P} % 777",
    "reduce_shuffle_bytes": f"{_P} * 900",
    "spilled_records": f"{_P} * 2",
    "heap_committed_bytes": f"{_P} * 4096",
    "virtual_mem_bytes": f"{_P} * 8192",
    "physical_mem_bytes": f"{_P} * 2048",
}

AGG_COLUMNS = {
    "flow_id": "cast(user_id as string)",
    "epoch_ms": "event_ms",
    "metric": "value",
    "payload": "props",
    "seq": "event_id",
    "kind": "event_type",
}

# A step writes /data/<flow>/<n>, reads what n-1 wrote and, when even, what n-2 wrote. Every third step also
# writes nothing of its own but reads a temporary path.
SINK_PATH = "'/data/' || flow_id || '/' || cast(step_number as string)"
SOURCE_TAPS = {
    "previous": ("true", "'/data/' || flow_id || '/' || cast(step_number - 1 as string)"),
    "before": ("step_number % 2 = 0", "'/data/' || flow_id || '/' || cast(step_number - 2 as string)"),
    "temporary": ("step_number % 3 = 0", "'/tmp/u' || cast(step_number % 4 as string) || '/' || flow_id"),
}

ARRIVAL = ["arrived", "seq_a", "seq_b"]


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} as {name}" for name, expression in columns.items())


class Tables:
    """The derived tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _epoch(column: str, unit: str = "SECOND"):
        return F.timestamp_diff(unit, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))

    @cached_property
    def flows(self) -> DataFrame:
        orders = self.raw("orders").withColumn("order_epoch", self._epoch("o_orderdate"))
        return orders.selectExpr(*[f"{e} as {n}" for n, e in FLOW_COLUMNS.items()])

    def step_updates_from(self, lineitem: DataFrame) -> DataFrame:
        lineitem = lineitem.withColumn("ship_epoch", self._epoch("l_shipdate"))
        return lineitem.selectExpr(*[f"{e} as {n}" for n, e in STEP_COLUMNS.items()])

    @cached_property
    def step_updates(self) -> DataFrame:
        return self.step_updates_from(self.raw("lineitem"))

    @cached_property
    def steps(self) -> DataFrame:
        # The narrow input row is ranked; the derived columns are computed after the shuffle.
        keys = ["l_orderkey", "l_linenumber"]
        order = ["l_shipdate", "l_partkey", "l_suppkey"]
        return self.step_updates_from(latest_per_key(self.raw("lineitem"), keys, order)).drop(*ARRIVAL)

    @cached_property
    def step_keys(self) -> DataFrame:
        keys = self.raw("lineitem").select("l_orderkey", "l_linenumber").distinct()
        return keys.selectExpr("cast(l_orderkey as string) as flow_id", "l_linenumber as step_number")

    @cached_property
    def taps(self) -> DataFrame:
        """Rows (flow_id, step_id, step_number, direction, path, fields)."""
        base = self.step_keys.withColumn("step_id", F.expr("flow_id || '-' || cast(step_number as string)"))
        rows = [F.struct(F.lit("sink").alias("direction"), F.expr(SINK_PATH).alias("path"))]
        for condition, path in SOURCE_TAPS.values():
            rows.append(F.when(F.expr(condition), F.struct(F.lit("source").alias("direction"), F.expr(path).alias("path"))))
        return (
            base.withColumn("tap", F.explode(F.array_compact(F.array(*rows))))
            .select("flow_id", "step_id", "step_number", "tap.direction", "tap.path")
            .withColumn("fields", F.array(F.lit("'id'"), F.concat(F.lit("f"), F.col("step_number").cast("string"))))
        )

    @cached_property
    def edges(self) -> DataFrame:
        return lineage_edges(self.taps)

    def agg_from(self, events: DataFrame) -> DataFrame:
        events = events.withColumn("event_ms", self._epoch("ts", "MILLISECOND"))
        return events.selectExpr(*[f"{e} as {n}" for n, e in AGG_COLUMNS.items()])

    @cached_property
    def agg(self) -> DataFrame:
        return self.agg_from(self.raw("events"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.raw("documents").selectExpr("text as line")


def _taps_sql() -> str:
    parts = [f"select flow_id, step_id, step_number, 'sink' as direction, {SINK_PATH} as path from step_keys"]
    for condition, path in SOURCE_TAPS.values():
        parts.append(
            f"select flow_id, step_id, step_number, 'source' as direction, {path} as path from step_keys where {condition}"
        )
    return " union all ".join(parts)


CTES = {
    "flows": f"select {_select(FLOW_COLUMNS)} from (select *, cast(epoch(o_orderdate) as bigint) as order_epoch from orders)",
    "step_updates": f"select {_select(STEP_COLUMNS)} from "
    "(select *, cast(epoch(l_shipdate) as bigint) as ship_epoch from lineitem)",
    "steps": "select * exclude (rn) from (select *, row_number() over "
    "(partition by step_id order by arrived desc, seq_a desc, seq_b desc) as rn from step_updates) where rn = 1",
    "step_keys": "select distinct flow_id, step_number, step_id from step_updates",
    "taps": _taps_sql(),
    "sinks": "select flow_id, path, max(step_number) as step_number from taps where direction = 'sink' group by all",
    "edges": "select distinct s.flow_id, s.step_number as src_stage, t.step_number as dest_stage from sinks s "
    "join taps t on t.flow_id = s.flow_id and t.path = s.path and t.direction = 'source'",
    "agg": f"select {_select(AGG_COLUMNS)} from (select *, epoch_us(ts) // 1000 as event_ms from events)",
    "lines": "select text as line from documents",
    "totals": "select flow_id, count(*) as n_steps, "
    + ", ".join(
        f"cast(sum(coalesce({c}, 0)) as bigint) as t_{c}"
        for c in (
            "map_tasks reduce_tasks hdfs_bytes_read hdfs_bytes_written gs_bytes_read gs_bytes_written file_bytes_read "
            "file_bytes_written cpu_millis map_vcore_millis reduce_vcore_millis step_running_time"
        ).split()
    )
    + " from steps group by flow_id",
}


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the table expressions it uses, directly or through one another."""
    bodies = {**CTES, **(extra or {})}
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name in bodies:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(bodies[name])
    parts = ", ".join(f"{name} as ({body})" for name, body in bodies.items() if name in needed)
    return f"with recursive {parts} {sql}" if parts else sql
