"""Keeping the latest state per key.

Updates carry ``update_date`` (epoch seconds) and one or more sequence columns that give their arrival order.
Built-in file tables cannot be merged in place, so each function returns the new table; the caller writes it to
a new path, keeps appending deltas (see ``jobmetrics.streaming.feeds``), or keeps the table in buckets of which only the
touched ones are written anew (see ``jobmetrics.sources.buckets``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmetrics.operators.skew import lag_in_slices

RUNNING_STEP = "RUNNING"


def collapse(updates: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Latest row per key; ``create_date`` is the date of the first one. Partial aggregation keeps one row per
    key and map task, so a key with very many updates costs no more shuffle than any other."""
    at = F.struct(*seq)
    first_date = "create_date" if "create_date" in updates.columns else "update_date"
    rest = [c for c in updates.columns if c not in keys and c != "create_date"]
    out = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), at).alias("_row"), F.min_by(first_date, at).alias("create_date")
    )
    return out.select(*keys, "_row.*", "create_date")


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Replace all columns of known keys by the last update, add unknown keys, keep the first ``create_date``.

    The updates are collapsed first, then one full outer join meets the current table, whose keys are unique.
    A table bucketed by its key (``sources.buckets``) joins without moving its rows.
    """
    fresh = collapse(updates, keys, seq).drop(*[c for c in seq if c not in current.columns])
    return merge_latest(current, fresh, keys)


def merge_latest(current: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The current rows, in place of which come fresh ones of the same key, but for the first ``create_date``."""
    columns = [c for c in current.columns if c not in keys]
    new_row = F.struct(*[F.col(c) for c in fresh.columns if c not in keys]).alias("_new")
    old_row = F.struct(*[F.col(c) for c in columns]).alias("_old")
    joined = current.select(*keys, old_row).join(fresh.select(*keys, new_row), list(keys), "full_outer")
    has_new = F.col("_new").isNotNull()
    picked = [
        F.coalesce("_old.create_date", "_new.create_date").alias(c)
        if c == "create_date"
        else F.when(has_new, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
        for c in columns
    ]
    return joined.select(*keys, *picked)


def upsert_flows(current: DataFrame, updates: DataFrame, seq: Sequence[str]) -> DataFrame:
    return upsert(current, updates, ["flow_id"], seq)


def upsert_steps(current: DataFrame, updates: DataFrame, seq: Sequence[str]) -> DataFrame:
    return upsert(current, updates, ["step_id"], seq)


def has_aggregated(updates: DataFrame) -> DataFrame:
    """Drop updates of old clients, which carry no aggregates."""
    return updates.filter(F.col("aggregated").isNotNull())


def merged(current: DataFrame, fresh: DataFrame, keys: Sequence[str], keep_old: bool) -> DataFrame:
    """One full outer join of two tables with unique keys; of a key in both, one side's row as a whole."""
    rest = [c for c in current.columns if c not in keys]
    old, new = F.struct(*rest).alias("_old"), F.struct(*rest).alias("_new")
    joined = current.select(*keys, old).join(fresh.select(*keys, new), list(keys), "full_outer")
    row = F.coalesce("_old", "_new") if keep_old else F.coalesce("_new", "_old")
    return joined.select(*keys, row.alias("_row")).select(*keys, "_row.*").select(*current.columns)


EDGE_KEYS = ["flow_id", "src_stage", "dest_stage"]
AGG_KEYS = ["epoch_ms", "flow_id"]


def first_edges(new: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Of each edge the first one to arrive."""
    rest = [c for c in new.columns if c not in EDGE_KEYS]
    first = new.groupBy(*EDGE_KEYS).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("_row"))
    return first.select(*EDGE_KEYS, "_row.*")


def last_snapshots(updates: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Of each snapshot the last one to arrive."""
    rest = [c for c in updates.columns if c not in AGG_KEYS]
    last = updates.groupBy(*AGG_KEYS).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row"))
    return last.select(*AGG_KEYS, "_row.*")


def insert_edges(current: DataFrame, new: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Add edges that are not there yet; the first one to arrive wins."""
    return merged(current, first_edges(new, seq), EDGE_KEYS, keep_old=True)


def upsert_agg(current: DataFrame, updates: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Snapshots by (epoch_ms, flow_id); the last write wins. There are no dates to keep."""
    return merged(current, last_snapshots(updates, seq), AGG_KEYS, keep_old=False)


def changed_steps(updates: DataFrame, seq: Sequence[str], bucket: str, known: DataFrame | None = None) -> DataFrame:
    """Updates worth sending: the first one of a step, running ones, and those that change the status.

    ``bucket`` cuts the arrival order into slices (a day, say), so the history of one busy step is spread out.
    ``known`` (step_id, step_status) gives the last status before these updates.
    """
    seen = lag_in_slices(updates, ["step_id"], bucket, seq, "step_status", "previous_status", known)
    status, previous = F.col("step_status"), F.col("previous_status")
    return seen.filter(previous.isNull() | (status == RUNNING_STEP) | (status != previous))
