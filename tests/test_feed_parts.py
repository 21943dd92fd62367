"""Feeds in parts: every input row is read by one part, and the parts together give the whole."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobmetrics.plans import feeds as plans
from jobmetrics.plans.all import QUERIES
from jobmetrics.plans.tables import Tables

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def tables(spark, tmp_path):
    """Sixty flows of three steps, with rows that come twice, null keys and steps without a number."""
    day = datetime(2001, 2, 3)
    keys = [*range(60), None]
    orders = [(k, 7, "F", 10.5, day, "1-URGENT") for k in keys]
    steps = [(k, 3 + (k or 0) % 5, 4, n, 17.0, 100.25, 0.0, 0.01, "N", "F", day) for k in keys for n in (1, 2, 3, None)]
    events = [(i, day, k, "view", 1.5, "{}") for i, k in enumerate(keys)]
    for name, rows, schema in (("orders", orders, ORDERS), ("lineitem", steps + steps[:40], LINEITEM), ("events", events, EVENTS)):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return Tables(spark, str(tmp_path))


def test_each_part_reads_its_own_files(tables, monkeypatch):
    monkeypatch.setattr(plans, "PART_BYTES", 1024)
    parts = [p.raw("lineitem") for p in plans.flow_parts(tables, tables.step_updates)]
    files = [{r[0] for r in p.select(F.input_file_name()).distinct().collect()} for p in parts]
    assert len(parts) > 1 and sum(len(f) for f in files) == len(set().union(*files))
    assert all("PartitionFilters: [isnotnull(_part" in p._jdf.queryExecution().executedPlan().toString() for p in parts)
    flows = [{r.l_orderkey for r in p.select("l_orderkey").collect()} for p in parts]
    assert sum(len(f) for f in flows) == 61
    assert sum(p.count() for p in parts) == tables.raw("lineitem").count()


def test_parts_do_not_grow_in_number_without_end(tables, monkeypatch):
    monkeypatch.setattr(plans, "PART_BYTES", 1)
    assert plans.part_count(tables, tables.step_updates, tables.flows) <= 32


def test_parts_give_the_whole(tables, monkeypatch):
    names = ("flows", "steps", "edges", "aggregates")
    whole = plans.ingested(tables)
    want = {n: sorted(map(str, getattr(whole, n).collect())) for n in names}
    read = QUERIES["s2_read_step_updates"].run(tables)
    updates = sorted(map(str, read.collect()))
    monkeypatch.setattr(plans, "PART_BYTES", 4096)
    assert plans.part_count(tables, tables.flows, tables.step_updates, tables.agg) > 2
    parted = plans.ingested(tables)
    assert {n: sorted(map(str, getattr(parted, n).select(*getattr(whole, n).columns).collect())) for n in names} == want
    again = QUERIES["s2_read_step_updates"].run(tables).select(*read.columns)
    assert sorted(map(str, again.collect())) == updates and len(updates) == 284


def test_ingested_posts_each_row_from_its_part(spark, tables, monkeypatch):
    monkeypatch.setattr(plans, "PART_BYTES", 4096)
    plain, read, rows = plans.posted, [], []

    def posted(t, df, name):
        read.extend(df.inputFiles())
        path = plain(t, df, name)
        if name == "all-steps":
            rows.append(spark.read.text(path).count())
        return path

    monkeypatch.setattr(plans, "posted", posted)
    plans.ingested(tables)
    assert len(rows) > 2 and sum(rows) == tables.raw("lineitem").count()
    assert read and all("/split-" in f for f in read)
