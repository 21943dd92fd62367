"""Selections, lookups and listings order."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmetrics.functions import status as st
from jobmetrics.functions.names import valid_flow_id
from jobmetrics.operators.skew import top_per_key

RUNNING_WINDOW_S = 600
COMPLETED_WINDOW_S = 21600
RESULT_LIMIT = 40


def newest_first(flows: DataFrame) -> DataFrame:
    return flows.orderBy(F.desc("create_date"), "flow_id")


def running_flows(flows: DataFrame, now: int, window_s: int = RUNNING_WINDOW_S) -> DataFrame:
    recent = F.col("update_date") > now - window_s
    return newest_first(flows.filter(recent & F.col("flow_status").isin(st.RUNNING)))


def completed_flows(flows: DataFrame, now: int, window_s: int = COMPLETED_WINDOW_S) -> DataFrame:
    recent = F.col("update_date") > now - window_s
    return newest_first(flows.filter(recent & F.col("flow_status").isin(st.COMPLETED)))


def all_completed(flows: DataFrame) -> DataFrame:
    return newest_first(flows.filter(F.col("flow_status").isin(st.COMPLETED)))


def completed_flow_ids(flows: DataFrame) -> DataFrame:
    return all_completed(flows.select("flow_id", "flow_status", "create_date")).select("flow_id")


def like_pattern(term: str) -> str:
    """URL-decoded term, first plus sign as a space, trimmed, blanks as wildcards. A backslash stands for itself."""
    text = unquote(term).replace("+", " ", 1).strip().replace("\\", "\\\\")
    return "%" + re.sub(r"\s+", "%", text) + "%"


def search_flows(flows: DataFrame, term: str, limit: int = RESULT_LIMIT) -> DataFrame:
    """Newest flows whose name contains the term, whatever the case."""
    return newest_first(flows.filter(F.col("flow_name").ilike(like_pattern(term)))).limit(limit)


def flow_history(flows: DataFrame, name: str, limit: int = RESULT_LIMIT) -> DataFrame:
    """Newest finished runs of one job."""
    return newest_first(flows.filter((F.col("flow_name") == name) & st.is_finished(F.col("flow_status")))).limit(limit)


def all_histories(flows: DataFrame, limit: int = RESULT_LIMIT) -> DataFrame:
    """The same for every job name at once."""
    finished = flows.filter(st.is_finished(F.col("flow_status")))
    return top_per_key(finished, ["flow_name"], [F.desc("create_date"), F.col("flow_id")], limit)


def steps_of(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """Steps of many flows; ``ids`` has a column flow_id."""
    return steps.join(ids.select("flow_id"), "flow_id", "left_semi")


def by_flow(table: DataFrame, flow_id: str) -> DataFrame:
    return table.filter(F.col("flow_id") == flow_id)


flow_by_id = by_flow
steps_by_flow = by_flow
edges_by_flow = by_flow
agg_by_flow = by_flow


def agg_between(agg: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Snapshots in a time range, both ends included."""
    return agg.filter(F.col("epoch_ms").between(start_ms, end_ms))


def by_cluster(flows: DataFrame, name: str | None = None) -> DataFrame:
    return flows if name is None else flows.filter(F.col("cluster_name") == name)


def by_cluster_ci(flows: DataFrame, name: str | None) -> DataFrame:
    """Case does not matter; no name, ``all`` and ``unknown`` keep every flow, as does a missing cluster."""
    if name is None or name.lower() in ("all", "unknown"):
        return flows
    cluster = F.col("cluster_name")
    return flows.filter(cluster.isNull() | (F.lower(cluster) == name.lower()))


def running_steps(steps: DataFrame) -> DataFrame:
    return steps.filter(F.col("step_status") == "RUNNING")


def by_initial(words: DataFrame, regex: str) -> DataFrame:
    return words.filter(F.col("word").rlike(regex))


def with_initial(words: DataFrame, groups: Mapping[str, str]) -> DataFrame:
    """Words whose beginning one of the named patterns takes, with the first such name as ``initial``, in one pass."""
    name = F.coalesce(*[F.when(F.col("word").rlike(regex), F.lit(group)) for group, regex in groups.items()])
    return words.withColumn("initial", name).filter(F.col("initial").isNotNull())


def split_by_flow_id(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates with a hexadecimal flow id, and the rest."""
    valid: Column = valid_flow_id(F.col("flow_id"))
    return updates.filter(valid), updates.filter(~valid)
