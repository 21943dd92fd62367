"""Which step feeds which: edges from shared paths, tap rows, inputs and outputs, edge labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmetrics.functions.names import UNKNOWN
from jobmetrics.functions.numbers import pretty_bytes, size_class
from jobmetrics.functions.status import mood, step_color
from jobmetrics.operators.skew import lookup


def lineage_edges(taps: DataFrame) -> DataFrame:
    """Edges (flow_id, src_stage, dest_stage) where a step reads a path that another step of the flow writes.

    ``taps`` has flow_id, step_number, direction ('source' or 'sink') and path. Two steps that write the same
    path: the later one counts. Unknown paths never match. The writer side is one row per path, so a path
    with many readers only makes the reader side large, which adaptive execution can split.
    """
    known = taps.filter(F.col("path").isNotNull() & (F.col("path") != UNKNOWN))
    writers = (
        known.filter(F.col("direction") == "sink")
        .groupBy("flow_id", "path")
        .agg(F.max("step_number").alias("src_stage"))
    )
    readers = known.filter(F.col("direction") == "source").select(
        "flow_id", "path", F.col("step_number").alias("dest_stage")
    )
    return lookup(readers, writers, ["flow_id", "path"]).select("flow_id", "src_stage", "dest_stage").distinct()


def all_edges(*edges: DataFrame) -> DataFrame:
    """Distinct edges of several sources, such as the planned order of steps and the paths they share."""
    columns = ["flow_id", "src_stage", "dest_stage"]
    return reduce(DataFrame.unionByName, [e.select(*columns) for e in edges]).distinct()


def flow_io(taps: DataFrame, flows: DataFrame) -> DataFrame:
    """Distinct input and output paths per flow, without those under its temporary directory."""
    paths = taps.select(
        "flow_id", F.when(F.col("direction") == "sink", "output").otherwise("input").alias("direction"), "path"
    ).distinct()
    kept = F.col("tmp_dir").isNull() | ~F.startswith(F.col("path"), F.col("tmp_dir"))
    return paths.join(flows.select("flow_id", "tmp_dir"), "flow_id").filter(kept).drop("tmp_dir")


def tap_rows(steps: DataFrame) -> DataFrame:
    """One row per source and sink of each step from the maps ``sources`` and ``sink``; field names as one text."""

    def side(column: str, direction: str) -> DataFrame:
        return steps.select(
            "flow_id", "step_id", "step_number", F.lit(direction).alias("direction"), F.explode(column).alias("path", "fields")
        )

    text = F.array_join(F.transform("fields", lambda f: F.replace(F.trim(f), F.lit("'"), F.lit(""))), ", ")
    return side("sources", "source").unionByName(side("sink", "sink")).withColumn(
        "fields", F.coalesce(text, F.lit(UNKNOWN))
    )


def flat_taps(taps: DataFrame) -> DataFrame:
    """Replace composite sources, given as an array ``children``, by their children."""
    children = F.when(F.size(F.coalesce("children", F.array())) > 0, F.col("children")).otherwise(F.array("path"))
    return taps.withColumn("path", F.explode(children)).drop("children")


def with_taps(steps: DataFrame, taps: DataFrame) -> DataFrame:
    """The steps with their taps, one row for each: direction, path and fields. Steps without taps stay, with nulls.

    Of several rows for one path of a step the largest field list stays.
    """
    keys = ["step_id", "direction", "path"]
    single = taps.withColumn("path", F.coalesce("path", F.lit(UNKNOWN))).groupBy(*keys).agg(F.max("fields").alias("fields"))
    return steps.join(single, "step_id", "left")


def labelled_edges(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges with the bytes their source step wrote. The text counts both file systems, the class HDFS only."""
    written = steps.select(
        "flow_id", F.col("step_number").alias("src_stage"), "hdfs_bytes_written", "gs_bytes_written"
    )
    both = F.col("hdfs_bytes_written") + F.coalesce("gs_bytes_written", F.lit(0))
    return edges.join(written, ["flow_id", "src_stage"]).select(
        "flow_id",
        "src_stage",
        "dest_stage",
        both.alias("bytes_written"),
        pretty_bytes(both).alias("label"),
        size_class(F.col("hdfs_bytes_written")).alias("label_class"),
    )


def graph_rows(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Vertices and labelled edges of every flow in one table."""
    status = F.col("step_status")
    vertices = steps.select(
        "flow_id",
        F.lit("vertex").alias("kind"),
        F.col("step_number").alias("src_stage"),
        F.lit(None).cast("int").alias("dest_stage"),
        F.coalesce("description", F.lit("")).alias("label"),
        step_color(status).alias("color"),
        mood(status).alias("mood"),
    )
    lines = labelled_edges(edges, steps).select(
        "flow_id",
        F.lit("edge").alias("kind"),
        "src_stage",
        "dest_stage",
        "label",
        F.col("label_class").alias("color"),
        F.lit(None).cast("string").alias("mood"),
    )
    return vertices.unionByName(lines)
