"""Registered queries: name -> (query over the derived tables, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from jobmetrics.plans.tables import Tables, with_tables


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, tables: dict[str, str] | None = None):
    """Register a query with the SQL that must give the same rows."""

    def add(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, with_tables(sql, tables) if sql else None)
        return run

    return add
