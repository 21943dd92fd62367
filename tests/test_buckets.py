"""Bucketed tables: only touched buckets are written, the current side of an update does not move."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobmetrics.operators import state
from jobmetrics.sources import buckets

SCHEMA = "flow_id string, flow_status string, update_date bigint, create_date bigint"
NAMES = ["flow_id", "flow_status", "update_date", "create_date"]
UPDATES = "flow_id string, flow_status string, update_date bigint, seq bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return buckets.BucketedTable(spark, str(tmp_path / "flows"), SCHEMA, ["flow_id"], 16)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equals_the_upsert_of_whole_tables(spark, table):
    rng, seq = random.Random(4), 0
    current = spark.createDataFrame([], SCHEMA)
    for size in (200, 3, 40):
        batch = [(f"f{rng.randrange(150)}", rng.choice("abc"), rng.randrange(100), seq := seq + 1) for _ in range(size)]
        updates = spark.createDataFrame(batch, UPDATES)
        buckets.upsert(table, updates, ["seq"])
        current = spark.createDataFrame(state.upsert_flows(current, updates, ["seq"]).select(*NAMES).collect(), SCHEMA)
        assert rows(table.read()) == rows(current)
    # Another session's view of the same files.
    assert rows(buckets.BucketedTable(spark, table.path, SCHEMA, ["flow_id"], 16).read()) == rows(current)
    table.forget(1)
    assert rows(buckets.BucketedTable(spark, table.path, SCHEMA, ["flow_id"], 16).read()) == rows(current)
    assert len(files(table.path)) == len(table.newest())


def test_untouched_buckets_keep_their_files(spark, table):
    first = spark.createDataFrame([(f"f{i}", "a", i, i) for i in range(400)], UPDATES)
    assert buckets.upsert(table, first, ["seq"]) == 0
    before = files(table.path)
    assert len(before) == 16 == len(table.newest())
    buckets.upsert(table, spark.createDataFrame([("f7", "b", 1, 1), ("f7", "c", 2, 2)], UPDATES), ["seq"])
    after = files(table.path)
    assert {p: t for p, t in after.items() if p in before} == before
    new = set(after) - set(before)
    assert len(new) == 1 and "version=1" in new.pop()
    assert rows(table.read().where("flow_id = 'f7'")) == [("f7", "c", 2, 7)]
    assert buckets.upsert(table, first.limit(0), ["seq"]) is None


def test_the_current_side_is_not_shuffled(spark, table):
    buckets.upsert(table, spark.createDataFrame([(f"f{i}", "a", i, i) for i in range(400)], UPDATES), ["seq"])
    fresh = spark.createDataFrame([("f7", "b", 1, 1)], SCHEMA)
    merged = state.merge_latest(table.read(), fresh, ["flow_id"])
    assert plan(merged).count("Exchange hashpartitioning") == 1
    assert "Exchange" not in plan(table.read().groupBy("flow_id").agg(F.max("update_date")))
    chosen = [r["bucket"] for r in fresh.select(table.bucket_of()).collect()]
    read = table.read(chosen)
    assert {Path(p).parent.name for p in read.inputFiles()} == {f"bucket={b}" for b in chosen}


def test_a_version_that_broke_off_does_not_count(spark, table):
    buckets.upsert(table, spark.createDataFrame([("a", "x", 1, 1)], UPDATES), ["seq"])
    before = rows(table.read())
    table.write(spark.createDataFrame([("a", "broken", 9, 9)], SCHEMA), 1)
    (Path(table.path) / "version=1" / "_SUCCESS").unlink()
    again = buckets.BucketedTable(spark, table.path, SCHEMA, ["flow_id"], 16)
    assert rows(again.read()) == before


def test_edges_and_snapshots(spark, tmp_path):
    edges = buckets.BucketedTable(spark, str(tmp_path / "edges"), "flow_id string, src_stage int, dest_stage int, update_date bigint, create_date bigint", state.EDGE_KEYS, 4)
    schema = "flow_id string, src_stage int, dest_stage int, update_date bigint, create_date bigint, seq bigint"
    buckets.insert_edges(edges, spark.createDataFrame([("f", 1, 2, 5, 5, 1)], schema), ["seq"])
    buckets.insert_edges(edges, spark.createDataFrame([("f", 1, 2, 9, 9, 1), ("f", 2, 3, 8, 8, 3), ("f", 2, 3, 7, 7, 2)], schema), ["seq"])
    assert rows(edges.read()) == [("f", 1, 2, 5, 5), ("f", 2, 3, 7, 7)]
    agg = buckets.BucketedTable(spark, str(tmp_path / "agg"), "epoch_ms bigint, flow_id string, agg_json string", state.AGG_KEYS, 4)
    buckets.upsert_agg(agg, spark.createDataFrame([(1, "f", "old", 1), (2, "f", "kept", 1)], "epoch_ms long, flow_id string, agg_json string, seq long"), ["seq"])
    buckets.upsert_agg(agg, spark.createDataFrame([(1, "f", "new", 2), (1, "f", "older", 1)], "epoch_ms long, flow_id string, agg_json string, seq long"), ["seq"])
    assert rows(agg.read()) == [(1, "f", "new"), (2, "f", "kept")]


def test_column_of_the_bucket_is_reserved(spark, tmp_path):
    with pytest.raises(ValueError):
        buckets.BucketedTable(spark, str(tmp_path), "bucket int", ["bucket"])
