"""From posted reports to the four stores: id check, one row per key, first date kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmetrics.operators import state
from jobmetrics.operators.select import split_by_flow_id
from jobmetrics.schemas import AGG_TABLE, EDGE_TABLE, FLOW_DOC, FLOW_TABLE, STEP_DOC, STEP_TABLE
from jobmetrics.sources.store import Store, TableNames, write_table

#: Order of arrival.
SEQ = ["update_date", "seq"]


def empty_store(spark: SparkSession) -> Store:
    return Store(*[spark.createDataFrame([], schema) for schema in (FLOW_TABLE, STEP_TABLE, EDGE_TABLE, AGG_TABLE)])


def _document(schema: T.StructType, name: str):
    return F.to_json(F.struct(*[f.name for f in schema])).alias(name)


def ingest(current: Store, flows: DataFrame, steps: DataFrame, edges: DataFrame, aggregates: DataFrame) -> Store:
    """The stores after the updates of the four feeds (``sources.feeds``). Updates whose flow id is not hexadecimal are left out,
    and flow reports without aggregates, which old clients send.
    """
    flows, steps, edges, aggregates = (split_by_flow_id(df)[0] for df in (flows, steps, edges, aggregates))
    flow_rows = state.has_aggregated(flows).select("flow_id", "flow_name", "flow_status", _document(FLOW_DOC, "flow_json"), "update_date", "seq")
    step_rows = steps.select("step_id", "flow_id", _document(STEP_DOC, "step_json"), "update_date", "seq")
    edge_rows = edges.withColumn("create_date", F.col("update_date"))
    return Store(
        state.upsert_flows(current.flows, flow_rows, SEQ).select(*FLOW_TABLE.names),
        state.upsert_steps(current.steps, step_rows, SEQ).select(*STEP_TABLE.names),
        state.insert_edges(current.edges, edge_rows, SEQ),
        state.upsert_agg(current.aggregates, aggregates.select("epoch_ms", "flow_id", "agg_json", "seq"), ["seq"]),
    )


def write_store(store: Store, root: str, names: TableNames = TableNames()) -> None:
    """Write the stores to a root that is not in use. Their JSON documents take half the disk with zstd that they take with snappy."""
    write_table(store.flows, root, names.flows, "update_date", ["flow_id"], compression="zstd")
    write_table(store.steps, root, names.steps, find=["flow_id", "step_id"], compression="zstd")
    write_table(store.edges, root, names.edges, find=["flow_id"], compression="zstd")
    write_table(store.aggregates, root, names.aggregates, "epoch_ms", ["flow_id"], compression="zstd")
