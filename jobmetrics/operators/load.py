"""Load view: running tasks as nodes around their jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmetrics.functions.numbers import map_group, reduce_group, task_radius
from jobmetrics.operators.select import running_steps

# Colour group and size of a job node.
JOB_GROUP = 31337
JOB_RADIUS = 20


def flows_with_steps(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """Every flow with its steps; flows without steps stay, with nulls."""
    return flows.join(steps, "flow_id", "left")


def job_nodes(flows: DataFrame) -> DataFrame:
    return flows.select(
        F.concat(F.lit("job:"), F.col("flow_id")).alias("node_id"),
        F.concat(F.col("flow_name"), F.lit(" ("), F.col("user_name"), F.lit(")")).alias("name"),
        F.lit(JOB_GROUP).alias("node_group"),
        F.lit(JOB_RADIUS).alias("radius"),
        "flow_id",
        F.lit(None).cast("string").alias("parent_id"),
        F.col("truncated_name").alias("txt"),
    )


def task_nodes(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """A map node for each running step and, if it has reducers, a reduce node."""
    number = F.col("step_number")

    def node(kind: str, tasks: str, group: Column) -> Column:
        count, plural = F.col(tasks).cast("string"), "mappers" if kind == "map" else "reducers"
        return F.struct(
            F.concat_ws(":", F.lit(kind), "flow_id", number.cast("string")).alias("node_id"),
            F.concat(F.lit("step: "), number.cast("string"), F.lit(" | "), count, F.lit(f" {plural}")).alias("name"),
            group.alias("node_group"),
            task_radius(F.col(tasks)).alias("radius"),
            F.lit(None).cast("string").alias("flow_id"),
            F.col("flow_id").alias("parent_id"),
            F.concat(count, F.lit(f" {plural}")).alias("txt"),
        )

    nodes = F.array(
        node("map", "map_tasks", map_group(number)),
        F.when(F.col("reduce_tasks") > 0, node("reduce", "reduce_tasks", reduce_group(number))),
    )
    shown = running_steps(steps).join(flows.select("flow_id"), "flow_id", "left_semi")
    return shown.select(F.explode(F.array_compact(nodes)).alias("n")).select("n.*")


def load_nodes(flows: DataFrame, steps: DataFrame) -> DataFrame:
    return task_nodes(flows, steps).unionByName(job_nodes(flows))


def load_links(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Link from each task node to the node of its job."""
    targets = jobs.select(F.col("flow_id").alias("parent_id"), F.col("node_id").alias("target"))
    return nodes.select(F.col("node_id").alias("source"), "parent_id").join(targets, "parent_id").select("source", "target")
