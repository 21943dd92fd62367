"""Selections, unpacking, lineage, links, load view and reports on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from jobmetrics.operators import cluster, hooks, lineage, links, load, select, series, totals, unpack, words
from jobmetrics.sources import feeds, reports
from jobmetrics.sources.text import read_lines, write_tsv


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FLOWS = "flow_id string, flow_name string, flow_status string, update_date long, create_date long"


@pytest.fixture(scope="module")
def flows(spark):
    return spark.createDataFrame(
        [
            ("a", "Daily Load", "RUNNING", 1000, 5),
            ("b", "daily x load", "STARTED", 400, 7),
            ("c", "Nightly", "SKIPPED", 999, 6),
            ("d", "Nightly", "FAILED", 10, 8),
            ("e", "Nightly", "PENDING", 1000, 9),
            ("f", "Nightly", "STOPPED", 1000, 9),
            ("g", "100%_sure", "SUCCESSFUL", 1000, 1),
        ],
        FLOWS,
    )


def ids(df):
    return [r.flow_id for r in df.collect()]


def test_windows_are_open_and_newest_first(flows):
    assert ids(select.running_flows(flows, 1000)) == ["a"]
    assert ids(select.running_flows(flows, 999)) == ["b", "a"]
    assert ids(select.completed_flows(flows, 1000, 991)) == ["f", "d", "c", "g"]
    assert ids(select.completed_flows(flows, 1000, 990)) == ["f", "c", "g"]
    assert ids(select.completed_flow_ids(flows)) == ids(select.all_completed(flows)) == ["f", "d", "c", "g"]


def test_search(flows):
    assert select.like_pattern("%20a+b+c  d ") == "%a%b+c%d%"
    assert ids(select.search_flows(flows, "DAILY+load")) == ["b", "a"]
    assert ids(select.search_flows(flows, "night", limit=2)) == ["e", "f"]
    assert ids(select.search_flows(flows, "1%25sure")) == ["g"]


def test_history(flows):
    assert ids(select.flow_history(flows, "Nightly")) == ["f", "d"]
    assert ids(select.flow_history(flows, "nightly")) == []
    assert sorted(ids(select.all_histories(flows, 1))) == ["f", "g"]


def test_clusters(spark, flows):
    config = cluster.ServerConfig(cluster_name_mapping={"h1": "One", "h2": ""}, cluster_name_regexes=[("^h(.)", "rule-$1")])
    hosts = flows.withColumn("jt_url", F.when(F.col("flow_id") < "c", F.lit("h1")).when(F.col("flow_id") == "c", "h2"))
    named = {r.flow_id: r.cluster_name for r in cluster.with_cluster(hosts, config).collect()}
    assert named == {"a": "One", "b": "One", "c": "rule-2", **dict.fromkeys("defg", "Unknown")}
    df = cluster.with_cluster(hosts, config)
    assert sorted(ids(select.by_cluster(df, "One"))) == ["a", "b"]
    assert sorted(ids(select.by_cluster(df, "one"))) == []
    assert sorted(ids(select.by_cluster_ci(df, "one"))) == ["a", "b"]
    for keep_all in (None, "All", "UNKNOWN"):
        assert select.by_cluster_ci(df, keep_all).count() == 7


def test_ids_and_ranges(spark):
    good, bad = select.split_by_flow_id(spark.createDataFrame([("AB12",), ("x",), (None,)], "flow_id string"))
    assert ids(good) == ["AB12"] and sorted(ids(bad), key=str) == [None, "x"]
    agg = spark.createDataFrame([(1,), (2,), (3,), (4,)], "epoch_ms long")
    assert rows(select.agg_between(agg, 2, 3)) == [(2,), (3,)]


def test_progress_and_totals(spark):
    steps = spark.createDataFrame(
        [("f", 50.0, 10.0, True, 5, None), ("f", 100.0, 77.0, False, 7, 3), ("g", 33.33, 0.0, None, 1, None)],
        "flow_id string, map_progress double, reduce_progress double, has_reduce_stage boolean, cpu_millis long, gs_bytes_read long",
    )
    got = totals.flow_totals(steps, {"n": F.count("*"), "top": F.max("cpu_millis")})
    assert rows(got.select("flow_id", "flow_progress", "flow_cpu_millis", "flow_gs_bytes_read", "n", "top")) == [
        ("f", 53.33, 12, 3, 2, 7),
        ("g", 33.33, 1, 0, 1, 1),
    ]
    assert rows(totals.flow_progress(steps.filter("flow_id = 'none'"))) == []


def test_unpacked_counters(spark):
    doc = {
        "step_number": 3,
        "step_id": "AB",
        "counters": {
            "mapreduce.FileSystemCounter": {"GS_BYTES_READ": 0, "HDFS_BYTES_READ": 7},
            "mapreduce.JobCounter": {"VCORES_MILLIS_MAPS": 1500},
        },
    }
    df = spark.createDataFrame(
        [("f", 1, 2, json.dumps(doc)), ("g", 1, 2, '{"step_id":"CD"}')], "flow_id string, create_date long, update_date long, step_json string"
    )
    out = {r.flow_id: r for r in unpack.unpack_steps(df, totals=True).collect()}
    first, second = out["f"], out["g"]
    assert (first.hdfs_bytes_read, first.gs_bytes_read, first.gs_bytes_written, first.map_vcore_secs) == (7, None, None, 2)
    assert (second.hdfs_bytes_read, second.spilled_records, second.config_props) == (0, 0, {})


def test_defaults_stand_for_zero(spark):
    df = spark.createDataFrame([({"g": {"a": 0, "b": 5}},)], "counters map<string,map<string,bigint>>")
    value = lambda name, default: unpack.counter(F.col("counters"), "g", name, default)
    assert tuple(df.select(value("a", 7), value("b", 7), value("c", 7), value("a", None)).first()) == (7, 5, 7, None)


def test_search_with_backslashes(spark):
    names = ["C:\\x", "C:x", "end\\", "50%_off"]
    df = spark.createDataFrame([(n, n, i) for i, n in enumerate(names)], "flow_id string, flow_name string, create_date long")
    found = lambda term: {r.flow_name for r in select.search_flows(df, term).collect()}
    assert found("C:\\x") == {"C:\\x"} and found("d\\") == {"end\\"} and found("c:") == {"C:\\x", "C:x"}


def test_edges_of_several_sources(spark):
    a = spark.createDataFrame([("f", 1, 2), ("f", 1, 2)], "flow_id string, src_stage int, dest_stage int")
    b = spark.createDataFrame([(2, "f", 1), (3, "f", 2)], "dest_stage int, flow_id string, src_stage int")
    assert rows(lineage.all_edges(a, b)) == [("f", 1, 2), ("f", 2, 3)]


def test_counters_keep_the_last_value(spark):
    data = [("s", "org.apache.hadoop.G$X", "a", 1, 1), ("s", "G", "a", 2, 2), ("s", "G", "b", 3, 1), ("t", "H", "a", 4, 1)]
    df = spark.createDataFrame(data, "step_id string, group_name string, counter_name string, value long, seq long")
    assert rows(unpack.counter_values(df, "seq")) == [("s", "G", "a", 2), ("s", "G", "b", 3), ("t", "H", "a", 4)]
    many = spark.range(30_000).selectExpr("'s' as step_id", "'G' as group_name", "cast(id as string) as counter_name", "id as value", "1L as seq")
    assert unpack.counter_values(many, "seq").count() == 30_000


def test_lineage(spark):
    taps = spark.createDataFrame(
        [
            ("f", 1, "sink", "/x"),
            ("f", 2, "sink", "/x"),
            ("f", 3, "source", "/x"),
            ("f", 3, "sink", "UNKNOWN"),
            ("f", 4, "source", "UNKNOWN"),
            ("f", 4, "source", None),
            ("g", 5, "source", "/x"),
        ],
        "flow_id string, step_number int, direction string, path string",
    )
    assert rows(lineage.lineage_edges(taps)) == [("f", 2, 3)]
    dirs = spark.createDataFrame([("f", "/x"), ("g", None)], "flow_id string, tmp_dir string")
    assert rows(lineage.flow_io(taps.filter("path is not null"), dirs)) == [
        ("f", "input", "UNKNOWN"),
        ("f", "output", "UNKNOWN"),
        ("g", "input", "/x"),
    ]


def test_steps_with_taps(spark):
    steps = spark.createDataFrame([("f", "s", 1), ("f", "t", 2)], "flow_id string, step_id string, step_number int")
    taps = spark.createDataFrame(
        [("s", "source", "/a", ["'x'", " y"]), ("s", "source", "/b", []), ("s", "sink", None, ["z"])],
        "step_id string, direction string, path string, fields array<string>",
    )
    assert rows(lineage.with_taps(steps, taps).select("step_id", "direction", "path", "fields")) == [
        ("s", "sink", "UNKNOWN", ["z"]),
        ("s", "source", "/a", ["'x'", " y"]),
        ("s", "source", "/b", []),
        ("t", None, None, None),
    ]
    many = spark.range(20_000).selectExpr("'s' as step_id", "'source' as direction", "cast(id as string) as path", "array('x') as fields")
    assert lineage.with_taps(steps, many).filter("step_id = 's'").count() == 20_000
    reported = spark.createDataFrame(
        [("f", "s", 1, {"/a": ["'x'", " y"], "/b": []}, {"UNKNOWN": ["z"]})],
        "flow_id string, step_id string, step_number int, sources map<string,array<string>>, sink map<string,array<string>>",
    )
    assert rows(lineage.tap_rows(reported).select("direction", "path", "fields")) == [
        ("sink", "UNKNOWN", "z"),
        ("source", "/a", "x, y"),
        ("source", "/b", ""),
    ]


LINK_STEPS = "flow_id string, step_number int, step_status string, job_id string, failed_map_tasks long, failed_reduce_tasks long, extra_links string"
LINK_FLOWS = "flow_id string, flow_name string, flow_status string, user_name string, jt_url string, yarn_job_history string, flow_links string"


def test_links(spark):
    steps = spark.createDataFrame(
        [
            ("f", 1, "FAILED", "job_9_1", 1, 0, "My+Log|h/%{job_name}/%{stage}?%{none};x|y|z;solo"),
            ("f", 2, "RUNNING", "job_9_2", 0, 0, None),
            ("f", 3, "FAILED", "NO_JOB_ID", 5, 5, None),
            ("g", 1, "FAILED", "job_8_1", 1, 1, None),
        ],
        LINK_STEPS,
    )
    flows = spark.createDataFrame(
        [
            ("f", "p.q.r", "FAILED", "u", "rm:1", "jh:2", "Client+Logs|l/%{flow_id}"),
            ("g", "n", "STOPPED", "u", "rm", "false", "Other|o;Client+Logs|l/%{flow_id}"),
        ],
        LINK_FLOWS,
    )
    described = flows.withColumn("truncated_name", F.col("flow_name"))
    assert rows(links.step_links(steps, described).select("flow_id", "step_number", "name", "url")) == sorted(
        [
            ("f", 1, "View Hadoop Logs", "//jh:19888/jobhistory/job/job_9_1"),
            ("f", 1, "Failed Map Tasks", "//jh:19888/jobhistory/attempts/job_9_1/m/FAILED"),
            ("f", 1, "ApplicationMaster", "//rm:8088/cluster/app/application_9_1"),
            ("f", 1, "My Log", "//h/p-q-r/1?"),
            ("f", 2, "View Hadoop Logs", "//jh:8088/proxy/application_9_2"),
            ("f", 2, "ApplicationMaster", "//rm:8088/cluster/app/application_9_2"),
            ("g", 1, "View Hadoop Logs", "http://rm:50030/jobdetails.jsp?jobid=job_8_1&refresh=0"),
        ],
        key=repr,
    )
    assert rows(links.failure_links(steps, described)) == [
        ("f", "Failed Map Tasks for Step 1", "//jh:19888/jobhistory/attempts/job_9_1/m/FAILED"),
        ("g", "Client Logs", "//l/g"),
    ]


def test_time_shares(spark):
    steps = spark.createDataFrame(
        [("f", 1, "RUNNING", 500), ("f", 2, "SUCCESSFUL", 397), ("f", 3, "FAILED", 1), ("z", 1, "PENDING", 0)],
        "flow_id string, step_number int, step_status string, step_running_time long",
    )
    got = series.time_shares(steps).select("flow_id", "step_number", "share", "tip")
    assert rows(got) == [
        ("f", 1, 1, "Step 1: 500 secs"),
        ("f", 2, 99, "Step 2: 397 secs"),
        ("f", 3, 1, "Step 3: 1 secs"),
        ("z", 1, None, "Step 1: Unknown"),
    ]


def test_load_view(spark):
    flows = spark.createDataFrame([("f", "job", "u", "job"), ("g", "idle", "v", "idle")], "flow_id string, flow_name string, user_name string, truncated_name string")
    steps = spark.createDataFrame(
        [("f", 1, "RUNNING", 60, 0), ("f", 2, "RUNNING", 1, 7), ("f", 3, "FAILED", 1, 1), ("x", 1, "RUNNING", 1, 1)],
        "flow_id string, step_number int, step_status string, map_tasks long, reduce_tasks long",
    )
    nodes = rows(load.load_nodes(flows, steps).select("node_id", "node_group", "radius", "parent_id", "txt"))
    assert nodes == sorted(
        [
            ("job:f", 31337, 20, None, "job"),
            ("job:g", 31337, 20, None, "idle"),
            ("map:f:1", 0, 10, "f", "60 mappers"),
            ("map:f:2", 2, 5, "f", "1 mappers"),
            ("reduce:f:2", 3, 5, "f", "7 reducers"),
        ],
        key=repr,
    )
    found = load.load_links(load.task_nodes(flows, steps), load.job_nodes(flows))
    assert rows(found) == [("map:f:1", "job:f"), ("map:f:2", "job:f"), ("reduce:f:2", "job:f")]


def test_reports(spark):
    df = spark.createDataFrame([("s", None, {"a": {"b": 1}})], "step_id string, n long, counters map<string,map<string,bigint>>")
    assert json.loads(reports.to_report(df).first().report) == {"step_id": "s", "n": None, "counters": {"a": {"b": 1}}}
    with pytest.raises(TypeError):
        reports.to_report(df.withColumn("d", F.current_date()))
    edges = spark.createDataFrame([("f", 1, b) for b in range(2, 40)] + [("f", 2, 3), ("f", 2, 3)], "flow_id string, src_stage int, dest_stage int")
    parts = [json.loads(r.report) for r in reports.edge_report(edges).collect()]
    assert sorted((a, b) for p in parts for a, bs in p.items() for b in bs) == sorted([("1", b) for b in range(2, 40)] + [("2", 3)])
    assert all(len(p) == 1 for p in parts)
    config = spark.createDataFrame([("user", "x"), ("job_name_prefix", "y"), ("port", "1")], "key string, value string")
    assert rows(reports.public_config(config)) == [("job_name_prefix", "y"), ("port", ""), ("user", "")]


def test_feed_shapes(spark, tmp_path):
    def posted(name, *lines):
        path = tmp_path / name
        path.mkdir()
        (path / "part.json").write_text("\n".join(json.dumps(x) for x in lines))
        return str(path)

    body = {"flow_id": "ignored", "flow_name": "n", "aggregated": {"flow_progress": 12.5}}
    flows = feeds.read_flow_updates(spark, posted("flows", {"flow_id": "f", "received": 9, "seq": 1, "body": body}))
    assert rows(flows.select("flow_id", "flow_name", F.to_json("aggregated"), "update_date")) == [("f", "n", '{"flow_progress":12.5}', 9)]
    steps = feeds.read_step_updates(
        spark, posted("steps", {"flow_id": "f", "received": 9, "seq": 1, "body": [{"step_id": "A", "step_number": 1}, {"step_id": "B"}]})
    )
    assert rows(steps.select("flow_id", "step_id", "step_number")) == [("f", "A", 1), ("f", "B", None)]
    edges = feeds.read_edges(spark, posted("edges", {"flow_id": "f", "received": 9, "seq": 1, "body": {"1": [2, 3], "2": [3]}}))
    assert rows(edges.select("flow_id", "src_stage", "dest_stage")) == [("f", 1, 2), ("f", 1, 3), ("f", 2, 3)]


def test_stored_documents_are_those_posted(spark, tmp_path):
    """Numbers stay numbers, whatever fields a report has; a malformed one is null and stops nothing."""
    from jobmetrics.sources.ingest import empty_store, ingest, write_store
    from jobmetrics.sources.store import load_store

    own = {"flow_progress": 12.5, "flow_cpu_millis": 9007199254740993, "mine": 0.1, "deep": {"a": [1, "x", None]}, "text": "7"}
    bodies = {"a1": own, "a2": {"flow_progress": "bad", "flow_cpu_millis": "x", "flow_gc_millis": 12.5}, "a3": None, "a4": {"flow_cpu_millis": "12"}}
    lines = [{"flow_id": k, "received": 9, "seq": 1, "body": {"flow_id": k, "flow_name": "n", "flow_status": "RUNNING", "aggregated": v}} for k, v in bodies.items()]
    metrics = {"m": 9007199254740993, "user": 1.5, "note": "text"}
    agg = [{"flow_id": "a1", "received": 9, "seq": 1, "body": {"flow_id": "a1", "epoch_ms": 5, "agg_json": metrics}}]
    for name, content in (("flows", lines), ("agg", agg), ("steps", []), ("edges", [])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text("\n".join(map(json.dumps, content)))
    paths = {name: str(tmp_path / name) for name in ("flows", "steps", "edges", "agg")}
    feeds_read = feeds.read_flow_updates(spark, paths["flows"]), feeds.read_step_updates(spark, paths["steps"]), feeds.read_edges(spark, paths["edges"])
    write_store(ingest(empty_store(spark), *feeds_read, feeds.read_agg(spark, paths["agg"])), str(tmp_path / "store"))
    store = load_store(spark, str(tmp_path / "store"))
    kept = {r.flow_id: json.loads(r.flow_json)["aggregated"] for r in store.flows.collect()}
    assert kept == {k: v for k, v in bodies.items() if v is not None}  # a report without aggregates is left out
    assert [json.loads(r.agg_json)["agg_json"] for r in store.aggregates.collect()] == [metrics]
    flows = totals.stored_totals(unpack.unpack_flows(store.flows, cluster.ServerConfig()))
    got = flows.select("flow_id", "flow_progress", "flow_cpu_millis", "flow_gc_millis", totals.aggregate_or(F.col("aggregated"), "mine", -1.0))
    assert rows(got) == [("a1", 12.5, 9007199254740993, None, 0.1), ("a2", None, None, 12, -1.0), ("a4", None, 12, None, -1.0)]


def test_words_and_hooks(spark, tmp_path):
    (tmp_path / "in.txt").write_text("Apple bee bee\nzoo APPLE, it's\n")
    counts = words.word_count(read_lines(spark, str(tmp_path / "in.txt")))
    assert rows(counts) == [("apple", 2), ("bee", 2), ("its", 1), ("zoo", 1)]
    joined = words.join_words(words.rarest(counts, words.OTHER, "word", "count", 1), words.rarest(counts, words.VOWEL, "swv", "swv_count", 1))
    assert set(rows(joined)) == {("zoo", 1, None, None), (None, None, "its", 1)}
    write_tsv(joined, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert sorted(text.splitlines()) == ['\t\tits\t1', 'zoo\t1\t\t']
    twice = hooks.chain(None, lambda df: df.filter("count = 2"), None)
    assert hooks.extract(counts, twice).count() == 2
