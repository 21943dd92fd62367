"""Update feeds: JSON lines, one posted report per line, as files or as a stream of files.

Each line is an envelope ``{"flow_id", "received", "seq", "body"}``: the flow the report was posted for, the
epoch second and the order of its arrival, and the report itself. Lines that cannot be read keep their text in
``_corrupt_record`` and are split off by ``split_rejects``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmetrics.schemas import AGG_DOC, EDGE_MAP, FLOW_DOC, STEP_DOC

CORRUPT = "_corrupt_record"


def read_feed(spark: SparkSession, path: str, body: T.DataType, stream: bool = False, **options: str) -> DataFrame:
    """Raw envelopes with a typed body. The document is parsed once, here."""
    schema = T.StructType(
        [
            T.StructField("flow_id", T.StringType()),
            T.StructField("received", T.LongType()),
            T.StructField("seq", T.LongType()),
            T.StructField("body", body),
            T.StructField(CORRUPT, T.StringType()),
        ]
    )
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).options(columnNameOfCorruptRecord=CORRUPT, **options).json(path)


def split_rejects(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable reports, and the text of those that are not, with what a cut report still says of its flow and order."""
    bad = F.col(CORRUPT).isNotNull() | F.col("body").isNull()

    def said(name: str, value: str) -> Column:
        return F.nullif(F.regexp_extract(F.coalesce(CORRUPT, F.lit("")), rf'"{name}"\s*:\s*{value}', 1), F.lit(""))

    rejects = feed.filter(bad).select(
        F.coalesce("flow_id", said("flow_id", '"([^"]+)"')).alias("flow_id"),
        F.coalesce("received", said("received", "([0-9]+)").try_cast("bigint")).alias("received"),
        F.coalesce("seq", said("seq", "([0-9]+)").try_cast("bigint")).alias("seq"),
        CORRUPT,
    )
    return feed.filter(~bad).drop(CORRUPT), rejects


def _dated(feed: DataFrame, *columns) -> DataFrame:
    return feed.select("flow_id", *columns, F.col("received").alias("update_date"), "seq")


def flow_updates(feed: DataFrame) -> DataFrame:
    """One row per flow report; the flow id of the route replaces that of the document."""
    fields = [_known(f"body.{f.name}", f.dataType).alias(f.name) for f in FLOW_DOC if f.name != "flow_id"]
    return _dated(feed, *fields)


def _known(name: str, kind: T.DataType) -> Column:
    """A field of a report; the null of an open document is no document."""
    return F.when(~F.is_variant_null(name), F.col(name)) if isinstance(kind, T.VariantType) else F.col(name)


def step_updates(feed: DataFrame) -> DataFrame:
    """One row per step in each report."""
    return _dated(feed.withColumn("step", F.explode("body")), "step.*")


def edge_updates(feed: DataFrame) -> DataFrame:
    """One row per edge of a stage -> targets map."""
    targets = feed.select("*", F.explode("body").alias("stage", "targets"))
    return _dated(
        targets.withColumn("dest_stage", F.explode("targets")), F.col("stage").cast("int").alias("src_stage"), "dest_stage"
    )


def agg_updates(feed: DataFrame) -> DataFrame:
    """One row per metric snapshot. The stored document is the whole report, its metrics one level down."""
    return feed.select(
        F.col("body.flow_id").alias("flow_id"),
        F.col("body.epoch_ms").alias("epoch_ms"),
        F.col("body.agg_json").alias("metrics"),
        F.to_json("body").alias("agg_json"),
        "seq",
    )


def read_flow_updates(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return flow_updates(split_rejects(read_feed(spark, path, FLOW_DOC, stream))[0])


def read_step_updates(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return step_updates(split_rejects(read_feed(spark, path, T.ArrayType(STEP_DOC), stream))[0])


def read_edges(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return edge_updates(split_rejects(read_feed(spark, path, EDGE_MAP, stream))[0])


def read_agg(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return agg_updates(split_rejects(read_feed(spark, path, AGG_DOC, stream))[0])
