"""Plain text in, tab-separated text out, and DOT graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmetrics.functions.names import split_label
from jobmetrics.operators.skew import lookup, top_per_key

# The two line shapes that carry the graph.
VERTEX = r'^\s+(\d+)\s+\[label\s+=\s+"(\d+_[A-Fa-f0-9]+)"\];$'
EDGE = r"^\s+(\d+)\s+->\s+([0-9 \t]+);$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").csv(path)


def read_dot(spark: SparkSession, path: str, flow_id: str = r"([^/]+)\.[^./]*$") -> DataFrame:
    """Lines (flow_id, line) of graph files, one graph each, as the tracker writes them; ``flow_id`` finds the id in the file's path.

    Lines are rows of their own, so files of any size are split. Line ends may be those of either system. The order of
    lines is not kept; where the last line of a node counts, use ``read_numbered_dot``.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("_file"), F.regexp_replace("value", "\r$", "").alias("line"))
    named = lines.select(F.regexp_extract(F.url_decode(F.regexp_replace("_file", r"\+", "%2B")), flow_id, 1).alias("flow_id"), "line")
    return named.filter(F.col("flow_id") != "")


def read_numbered_dot(spark: SparkSession, path: str, flow_id: str = r"([^/]+)\.[^./]*$") -> DataFrame:
    """As ``read_dot``, with ``line_no``, by which the lines of a file have their order: where their split of the file begins, and
    their place in it. A split is read by one task from front to back, so files of any size are split here too."""
    name = F.regexp_extract(F.url_decode(F.regexp_replace(F.input_file_name(), r"\+", "%2B")), flow_id, 1)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    lines = spark.read.text(path).select(name.alias("flow_id"), place.alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))
    return lines.filter(F.col("flow_id") != "")


def dot_vertices(lines: DataFrame) -> DataFrame:
    """Rows (flow_id, node, stage, step_id)."""
    found = lines.filter(F.col("line").rlike(VERTEX))
    label = split_label(F.regexp_extract("line", VERTEX, 2))
    return found.select("flow_id", F.regexp_extract("line", VERTEX, 1).alias("node"), label.alias("l")).select(
        "flow_id", "node", "l.*"
    )


def dot_edges(lines: DataFrame, last_line_wins: bool = False) -> DataFrame:
    """Distinct edges (flow_id, src_stage, dest_stage). With ``last_line_wins`` only the last line of each node
    counts, by ``line_no``, else all of them."""
    found = lines.filter(F.col("line").rlike(EDGE)).select(
        "flow_id",
        *(["line_no"] if last_line_wins else []),
        F.regexp_extract("line", EDGE, 1).alias("node"),
        F.split(F.trim(F.regexp_extract("line", EDGE, 2)), r"\s+").alias("targets"),
    )
    if last_line_wins:
        found = top_per_key(found, ["flow_id", "node"], [F.desc("line_no")])
    stages = dot_vertices(lines).groupBy("flow_id", "node").agg(F.max("stage").alias("stage"))
    src = stages.withColumnRenamed("stage", "src_stage")
    dest = stages.withColumnsRenamed({"node": "target", "stage": "dest_stage"})
    pairs = found.select("flow_id", "node", F.explode("targets").alias("target"))
    known = lookup(lookup(pairs, src, ["flow_id", "node"]), dest, ["flow_id", "target"])
    return known.select("flow_id", "src_stage", "dest_stage").distinct()
