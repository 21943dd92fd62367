"""Reports for transport, and public configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings whose value is not shown.
HIDDEN_SETTINGS = [
    "user",
    "password",
    "host",
    "port",
    "database",
    "flow_table_alias",
    "step_table_alias",
    "edge_table_alias",
    "agg_table_alias",
]

_PLAIN = (T.BooleanType, T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.StringType, T.NullType)


def _check(kind: T.DataType, name: str) -> None:
    if isinstance(kind, T.ArrayType):
        _check(kind.elementType, name)
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError(f"{name}: map keys must be strings")
        _check(kind.valueType, name)
    elif isinstance(kind, T.StructType):
        for field in kind:
            _check(field.dataType, f"{name}.{field.name}")
    elif not isinstance(kind, _PLAIN):
        raise TypeError(f"{name}: {kind.simpleString()} cannot be reported")


def to_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``report``, the columns as JSON text. Types without a JSON form here are refused; nulls are kept."""
    wanted = list(columns or df.columns)
    for name in wanted:
        _check(df.schema[name].dataType, name)
    return df.withColumn("report", F.to_json(F.struct(*wanted), {"ignoreNullFields": "false"}))


def edge_report(edges: DataFrame) -> DataFrame:
    """One document for each edge, its map of one stage to one target as JSON text. Receivers add up edge maps."""
    single = edges.select("flow_id", "src_stage", "dest_stage").distinct()
    report = F.to_json(F.create_map(F.col("src_stage").cast("string"), F.array("dest_stage")))
    return single.select("flow_id", "src_stage", "dest_stage", report.alias("report"))


def public_config(settings: DataFrame, hidden: Sequence[str] = HIDDEN_SETTINGS) -> DataFrame:
    """Rows (key, value) with the values of hidden settings set to empty."""
    return settings.withColumn("value", F.when(F.col("key").isin(list(hidden)), "").otherwise(F.col("value")))
