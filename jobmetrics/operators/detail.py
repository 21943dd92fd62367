"""Everything about a run: the flow, its steps and its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmetrics.operators.lineage import labelled_edges


def flow_detail(flows: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per part of a run: ``part`` is flow, step or edge, each with the name and status of its flow.

    Parts stay rows, so a run with very many steps never becomes one huge row.
    """
    null_text = F.lit(None).cast("string")
    null_int = F.lit(None).cast("int")
    parts = flows.select(
        "flow_id", F.lit("flow").alias("part"), null_int.alias("step_number"), null_int.alias("dest_stage"),
        null_text.alias("step_status"), null_text.alias("label"),
    ).unionByName(
        steps.select(
            "flow_id", F.lit("step").alias("part"), "step_number", null_int.alias("dest_stage"), "step_status", null_text.alias("label")
        )
    ).unionByName(
        labelled_edges(edges, steps).select(
            "flow_id", F.lit("edge").alias("part"), F.col("src_stage").alias("step_number"), "dest_stage",
            null_text.alias("step_status"), "label",
        )
    )
    return parts.join(flows.select("flow_id", "flow_name", "flow_status"), "flow_id")
