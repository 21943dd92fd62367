"""Posted feeds take little disk: gzipped, and gone once the stores are written."""

import os

from jobmetrics.plans import feeds as plans
from jobmetrics.plans.all import QUERIES
from jobmetrics.plans.tables import Tables
from jobmetrics.runtime import scratch_root
from jobmetrics.sources import feeds

SMALL = "/root/testdata/sf0.001"


def test_posted_feed_is_gzipped_and_reads_back(spark):
    t = Tables(spark, SMALL)
    step = spark.range(3).selectExpr("cast(id as string) as step_id", "cast(id as int) as step_number")
    reports = step.selectExpr("'0a' as flow_id", "1L as received", "cast(step_number as bigint) as seq", "array(struct(step_id, step_number)) as body")
    path = plans.posted(t, reports, "gz-feed")
    parts = [f for f in os.listdir(path) if f.startswith("part-")]
    assert parts and all(f.endswith(".json.gz") for f in parts)
    read = feeds.read_step_updates(spark, path)
    assert sorted(r.step_id for r in read.collect()) == ["0", "1", "2"]


def test_ingested_removes_its_feeds(spark):
    root = scratch_root(spark)
    store = plans.ingested(Tables(spark, SMALL))
    left = [d for d in os.listdir(root) if d.startswith(("all-flows-", "all-steps-", "all-edges-", "all-agg-"))]
    assert left == []
    assert store.steps.count() > 0


def test_step_feed_read_in_parts_is_whole_and_leaves_no_feed(spark, monkeypatch):
    monkeypatch.setattr(plans, "PART_BYTES", 1 << 14)
    t = Tables(spark, SMALL)
    assert len(plans.flow_parts(t, t.step_updates)) > 1
    root = scratch_root(spark)
    got = QUERIES["s2_read_step_updates"].run(t)
    want = t.step_updates.selectExpr(
        "flow_id", "step_id", "step_number", "step_status", "map_progress", "has_reduce_stage", "cpu_millis", "gs_bytes_read", "seq_a as seq"
    )
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert [d for d in os.listdir(root) if d.startswith("step-feed-")] == []


def test_ingested_in_parts_gives_the_whole_stores(spark, monkeypatch):
    t = Tables(spark, SMALL)
    whole = plans.ingested(t)
    monkeypatch.setattr(plans, "PART_BYTES", 1 << 14)
    assert plans.part_count(t, t.flows, t.step_updates) > 1
    parted = plans.ingested(t)
    for name in ("flows", "steps", "edges", "aggregates"):
        a, b = getattr(whole, name), getattr(parted, name)
        assert a.count() == b.count() > 0
        assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_ingested_stores_are_zstd(spark):
    store = plans.ingested(Tables(spark, SMALL))
    files = store.steps.inputFiles() + store.flows.inputFiles()
    assert files and all(".zstd." in f for f in files)
