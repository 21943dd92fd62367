"""The four stores as Parquet tables under one root."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TableNames:
    flows: str = "flows"
    steps: str = "steps"
    edges: str = "edges"
    aggregates: str = "aggregates"


@dataclass(frozen=True)
class Store:
    flows: DataFrame
    steps: DataFrame
    edges: DataFrame
    aggregates: DataFrame


def load_store(spark: SparkSession, root: str, names: TableNames = TableNames()) -> Store:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}")

    return Store(read(names.flows), read(names.steps), read(names.edges), read(names.aggregates))


def write_table(df: DataFrame, root: str, name: str, sort: str | None = None, find: Sequence[str] = (), **options: str) -> None:
    """Write one store to a path that is not in use. Sorting inside the files by the column that selections
    test lets row-group statistics skip most of them, and needs no shuffle.

    ``find`` are columns by which single rows are looked up. Each row group gets a Bloom filter of their values, sized by how many
    there are, so a lookup reads the row groups that hold the value and hardly any others. ``options`` are the writer's.
    """
    out = df.sortWithinPartitions(sort) if sort else df
    writer = out.write.options(**options)
    for column in find:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(f"{root}/{name}")
