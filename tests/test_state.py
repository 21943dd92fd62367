"""Upserts, change detection, and streams that must equal their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from jobmetrics.operators import state
from jobmetrics.operators.skew import lag_in_slices, lookup, rank_in_slices, top_per_key
from jobmetrics.sources import buckets
from jobmetrics.streaming import feeds as streams

COLUMNS = "flow_id string, flow_status string, aggregated string, update_date long, seq long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_keeps_create_date_and_replaces_the_rest(spark):
    current = spark.createDataFrame(
        [("a", "RUNNING", "x", 10, 5), ("b", "FAILED", "y", 11, 6)],
        "flow_id string, flow_status string, aggregated string, update_date long, create_date long",
    )
    updates = spark.createDataFrame(
        [("a", "STOPPED", None, 20, 2), ("a", "RUNNING", "z", 30, 1), ("c", "PENDING", "q", 21, 3), ("c", "RUNNING", "r", 22, 4)], COLUMNS
    )
    got = state.upsert_flows(current, updates, ["seq"]).select("flow_id", "flow_status", "aggregated", "update_date", "create_date")
    assert rows(got) == [
        ("a", "STOPPED", None, 20, 5),
        ("b", "FAILED", "y", 11, 6),
        ("c", "RUNNING", "r", 22, 21),
    ]


def test_first_edge_wins(spark):
    schema = "flow_id string, src_stage int, dest_stage int, update_date long, create_date long"
    current = spark.createDataFrame([("f", 1, 2, 5, 5)], schema)
    new = spark.createDataFrame([("f", 1, 2, 9, 9, 1), ("f", 2, 3, 8, 8, 3), ("f", 2, 3, 7, 7, 2)], schema + ", seq long")
    assert rows(state.insert_edges(current, new, ["seq"])) == [("f", 1, 2, 5, 5), ("f", 2, 3, 7, 7)]


def test_last_snapshot_wins(spark):
    schema = "epoch_ms long, flow_id string, agg_json string"
    current = spark.createDataFrame([(1, "f", "old"), (2, "f", "kept")], schema)
    updates = spark.createDataFrame([(1, "f", "new", 2), (1, "f", "older", 1)], schema + ", seq long")
    assert rows(state.upsert_agg(current, updates, ["seq"])) == [(1, "f", "new"), (2, "f", "kept")]


def history(spark, n=400, seed=3):
    """Most rows belong to one step; statuses repeat."""
    rng = random.Random(seed)
    data = [
        ("hot" if rng.random() < 0.5 else f"s{rng.randrange(20)}", rng.choice(["RUNNING", "FAILED", "SUCCESSFUL"]), i, i // 37)
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, "step_id string, step_status string, seq long, day long")


def expected_changes(data):
    last, out = {}, []
    for step, status, seq, _ in sorted(data, key=lambda r: r[2]):
        previous = last.get(step)
        if previous is None or status == "RUNNING" or status != previous:
            out.append((step, status, seq, previous))
        last[step] = status
    return sorted(out, key=repr)


def test_changed_steps(spark):
    data, df = history(spark)
    got = state.changed_steps(df, ["seq"], "day").select("step_id", "step_status", "seq", "previous_status")
    assert rows(got) == expected_changes(data)


def test_streams_equal_batch(spark, tmp_path):
    """Several micro-batches, one of them run twice."""
    data, df = history(spark)
    source = str(tmp_path / "in")
    for part in range(4):
        df.filter((F.col("seq") >= part * 100) & (F.col("seq") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(source)
    out, log, checkpoint = (str(tmp_path / x) for x in ("out", "log", "checkpoint"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.changed_steps_stream(stream, out, log, checkpoint, ["seq"], "day", refresh=None).awaitTermination()
    got = spark.read.parquet(out).select("step_id", "step_status", "seq", "previous_status")
    assert rows(got) == expected_changes(data)
    assert spark.read.parquet(out).select("batch").distinct().count() == 4

    updates = stream.withColumn("update_date", F.col("seq"))
    state_log = str(tmp_path / "state")
    keys, seq = ["step_id"], ["seq"]
    streams.upsert_stream(updates, state_log, str(tmp_path / "c2"), keys, seq, refresh=None).awaitTermination()
    want = rows(state.collapse(df.withColumn("update_date", F.col("seq")), keys, seq).select("step_id", "step_status", "seq", "create_date"))
    read = lambda path: rows(streams.read_state(spark, path, updates.schema, keys, seq).select("step_id", "step_status", "seq", "create_date"))
    assert read(state_log) == want


@pytest.mark.parametrize("every", [1, 3])
def test_a_batch_reads_no_more_the_longer_the_stream_runs(spark, tmp_path, every):
    data, df = history(spark)
    schema = df.withColumns({"update_date": F.lit(0), "create_date": F.lit(0)}).schema
    log = streams.Log(spark, str(tmp_path / "log"), schema, ["step_id"], ["seq"], every, 4)
    read = []
    for batch in range(12):
        part = df.filter((F.col("seq") >= batch * 30) & (F.col("seq") < batch * 30 + 30)).withColumns({"update_date": F.lit(0), "create_date": F.lit(0)})
        for _ in range(2):  # each batch runs twice
            read.append(len(log._open(batch)) + bool(log.base.newest(batch)))
            log.write(part.groupBy("step_id").agg(F.max_by(F.struct(*[c for c in schema.names if c != "step_id"]), "seq").alias("r")).select("step_id", "r.*"), batch)
    assert max(read) <= every
    latest = {r.step_id: r.seq for r in df.filter("seq < 360").groupBy("step_id").agg(F.max("seq").alias("seq")).collect()}
    assert {r.step_id: r.seq for r in log.read().collect()} == latest
    assert len(log._batches()) <= 2 * every and max(log.base.newest().values()) == 11


def rows_scanned(df):
    """Rows that the one scan of a plan gives out, after files and pages were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_a_batch_reads_no_more_the_more_keys_there_are(spark, tmp_path):
    """The state of the keys of a batch, in logs of 2 thousand and 200 thousand steps."""
    schema = "step_id string, step_status string, seq bigint, update_date int, create_date int"
    read, found = {}, {}
    for n in (2_000, 200_000):
        log = streams.Log(spark, str(tmp_path / f"log{n}"), spark.createDataFrame([], schema).schema, ["step_id"], ["seq"], 1, 4)
        every = spark.range(n).selectExpr("md5(string(id)) as step_id", "'RUNNING' as step_status", "id as seq", "0 as update_date", "0 as create_date")
        log.write(every, 0)
        batch = every.filter("seq < 3").select("step_id")
        known = log.read(1, batch)
        found[n] = rows(known.join(batch, "step_id").select("seq"))
        read[n] = rows_scanned(log.base.near(batch))
        assert rows_scanned(log.base.read()) == n
    assert found[2_000] == found[200_000] == [(0,), (1,), (2,)]
    # A page or two for each key, however many there are.
    assert read[200_000] <= 3 * 2 * buckets.PAGE_ROWS


def test_folding_writes_only_buckets_with_new_rows(spark, tmp_path):
    schema = "step_id string, step_status string, seq bigint, update_date int, create_date int"
    log = streams.Log(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema, ["step_id"], ["seq"], 2, 16)
    for batch in range(4):
        data = [(f"s{i}", "RUNNING", batch * 1000 + i, batch, batch) for i in range(200)] if batch < 2 else [("s7", "DONE", batch * 1000, batch, batch)]
        log.write(spark.createDataFrame(data, schema), batch)
    assert log.base.versions() == [1, 3]
    assert sorted(log.base.newest().values()) == [1] * 15 + [3]
    assert rows(log.read().filter("step_id = 's7'")) == [("s7", "DONE", 3000, 3, 0)]
    assert log.read().count() == 200


def test_rejects_stream_and_tolerance(spark, tmp_path):
    from jobmetrics.schemas import AGG_DOC
    from jobmetrics.sources import feeds

    source = tmp_path / "feed"
    source.mkdir()
    good = '{"flow_id":"f","received":1,"seq":%d,"body":{"flow_id":"f","epoch_ms":%d,"agg_json":{"a":1.5}}}'
    (source / "a.json").write_text("\n".join([good % (1, 10), '{"flow_id":"f","bo', good % (2, 20), '{"flow_id":"f"}']))
    fine, bad = feeds.split_rejects(feeds.read_feed(spark, str(source), AGG_DOC, stream=True))
    out = str(tmp_path / "rejects")
    streams.append_rejects(bad, out, str(tmp_path / "cp"), refresh=None).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert fine.isStreaming
    assert [tuple(r) for r in feeds.read_agg(spark, str(source)).select("epoch_ms", "seq").orderBy("seq").collect()] == [(10, 1), (20, 2)]

    updates = spark.createDataFrame([("f", i) for i in range(8)] + [("g", 0)], "flow_id string, seq long")
    failures = spark.createDataFrame([("f", 3), ("f", 5), ("f", 6), ("g", 0)], "flow_id string, seq long")
    # The report after the second failure is the final one; a third failure in its place leaves none.
    assert rows(streams.within_tolerance(updates, failures, "seq", 2)) == [*[("f", i) for i in range(5)], ("f", 6), ("g", 0)]
    later = updates.filter("seq <> 6")
    assert rows(streams.within_tolerance(later, failures, "seq", 2)) == [*[("f", i) for i in range(5)], ("g", 0)]


def test_tolerance_over_batches(spark, tmp_path):
    """Three failures end the tracking of a flow, wherever the batches are cut."""
    from jobmetrics.schemas import AGG_DOC
    from jobmetrics.sources import feeds

    source, (out, log, checkpoint) = tmp_path / "feed", (str(tmp_path / x) for x in ("out", "log", "checkpoint"))
    source.mkdir()
    rng = random.Random(5)
    reports = [(rng.choice("fgh"), seq, rng.random() < 0.2) for seq in range(60)]
    want, failed, ended = [], {}, set()
    for flow, seq, bad in reports:
        final = failed.get(flow, 0) >= 3 and flow not in ended
        ended |= {flow} if final else set()
        failed[flow] = failed.get(flow, 0) + bad
        if not bad and (failed[flow] < 3 or final):
            want.append((flow, seq))
    good = '{"flow_id":"%s","received":1,"seq":%d,"body":{"flow_id":"x","epoch_ms":1,"agg_json":{}}}'
    cut = '{"flow_id":"%s","received":1,"seq":%d,"bod'
    for part in range(6):
        lines = [(cut if bad else good) % (flow, seq) for flow, seq, bad in reports[part * 10 : part * 10 + 10]]
        (source / f"{part}.json").write_text("\n".join(lines))
        feed = feeds.read_feed(spark, str(source), AGG_DOC, stream=True)
        streams.tolerant_stream(feed, out, log, checkpoint, limit=3, refresh=None).awaitTermination()
    assert rows(spark.read.parquet(out).select("flow_id", "seq")) == sorted(want, key=repr)


def test_slices(spark):
    data = [("a" if i % 3 else "b", i // 10, i, f"v{i}") for i in range(100)]
    df = spark.createDataFrame(data, "k string, slice long, at long, v string")
    by_key = {k: sorted(at for key, _, at, _ in data if key == k) for k in "ab"}
    lagged = {(r.k, r.at): r.p for r in lag_in_slices(df, ["k"], "slice", ["at"], "v", "p").collect()}
    ranked = {(r.k, r.at): r.n for r in rank_in_slices(df, ["k"], ["slice"], ["at"], "n").collect()}
    for k, ats in by_key.items():
        for i, at in enumerate(ats):
            assert lagged[k, at] == (f"v{ats[i - 1]}" if i else None)
            assert ranked[k, at] == i + 1
    assert rows(top_per_key(df, ["k"], [F.desc("at")], 2).select("k", "at")) == [("a", 97), ("a", 98), ("b", 96), ("b", 99)]


def test_lookup_by_keys_of_any_type(spark):
    for kind, values in {
        "string": "'a'", "bigint": "1L", "int": "1", "double": "1.5D", "boolean": "true", "date": "date'2001-02-03'",
        "timestamp": "timestamp'2001-02-03 04:05:06'", "decimal(10,2)": "1.25BD", "binary": "X'01'",
    }.items():
        df = spark.range(6).selectExpr(f"case when id < 4 then cast({values} as {kind}) end as k", "id")
        counts = df.groupBy("k").count()
        assert [r["count"] for r in lookup(df, counts, ["k"]).collect()] == [4] * 4, kind
        assert lookup(df, counts, ["k"], "left").count() == 6


def test_lag_keeps_null_values(spark):
    df = spark.createDataFrame([("k", 0, 1, "x"), ("k", 0, 2, None), ("k", 1, 3, "y")], "k string, slice int, at int, v string")
    assert {r.at: r.p for r in lag_in_slices(df, ["k"], "slice", ["at"], "v", "p").collect()} == {1: None, 2: "x", 3: None}


def test_timed_trigger_takes_up_what_arrives_while_it_runs(spark, tmp_path):
    """The stream runs on at its interval, and a final flush takes what came after it was stopped."""
    import time

    source, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "checkpoint"))
    schema = "step_id string, step_status string, seq bigint, update_date bigint"

    def arrive(*rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(source)

    def state_now():
        stream = spark.readStream.schema(schema).parquet(source)
        return rows(streams.read_state(spark, log, stream.schema, ["step_id"], ["seq"], 2).select("step_id", "step_status", "create_date"))

    arrive(("a", "PENDING", 1, 10))
    stream = spark.readStream.schema(schema).parquet(source)
    query = streams.upsert_stream(stream, log, checkpoint, ["step_id"], ["seq"], refresh="1 seconds", buckets=2)
    try:
        query.processAllAvailable()
        assert query.isActive and state_now() == [("a", "PENDING", 10)]
        arrive(("a", "RUNNING", 2, 20), ("b", "PENDING", 3, 20))
        limit = time.time() + 60
        while time.time() < limit and len(state_now()) < 2:
            time.sleep(0.5)
        assert state_now() == [("a", "RUNNING", 10), ("b", "PENDING", 20)]
    finally:
        query.stop()
    arrive(("a", "DONE", 4, 30))
    streams.upsert_stream(stream, log, checkpoint, ["step_id"], ["seq"], refresh=None, buckets=2).awaitTermination()
    assert state_now() == [("a", "DONE", 10), ("b", "PENDING", 20)]
