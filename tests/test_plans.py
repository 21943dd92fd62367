"""Plans that must hold at scale: pruning, pushdown, early limits, splittable joins, no pair products."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from jobmetrics.operators import graph, lineage, select, series, unpack
from jobmetrics.sources.store import TableNames, load_store, write_table

SMALL = "/root/testdata/sf0.001"
# These start streams or loops when called; their plans only read back what those wrote.
EAGER = ("g3", "g4", "g5", "g6", "g7", "g8", "r1", "r5", "r6", "s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8", "r3_f", "r3_tol", "op", "pipeline")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df)


@pytest.mark.parametrize("name", [n for n in sorted(entry_module.queries()) if not n.startswith(EAGER)])
def test_no_products_and_no_python(spark, name):
    text = plan(entry_module.queries()[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert operator not in text


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root, names = str(tmp_path_factory.mktemp("store")), TableNames()
    flows = spark.range(20000).select(
        F.col("id").cast("string").alias("flow_id"),
        F.concat(F.lit("job"), F.col("id") % 7).alias("flow_name"),
        F.element_at(F.array(*[F.lit(s) for s in ("RUNNING", "FAILED", "STOPPED", "PENDING")]), (F.col("id") % 4 + 1).cast("int")).alias("flow_status"),
        F.lit("{}").alias("flow_json"),
        (F.col("id") + 1000).alias("update_date"),
        F.col("id").alias("create_date"),
    )
    write_table(flows, root, names.flows, "update_date")
    for name in (names.steps, names.edges, names.aggregates):
        write_table(flows.select("flow_id"), root, name)
    return load_store(spark, root)


def test_selection_is_pushed_down_and_pruned(store):
    text = plan(select.running_flows(store.flows, 20000).select("flow_id"))
    assert "GreaterThan(update_date,19400)" in text and "In(flow_status" in text
    assert "flow_json" not in text.split("ReadSchema")[1]


def test_limits_come_early(store):
    assert "TakeOrderedAndProject" in plan(select.flow_history(store.flows, "job1"))
    text = plan(select.all_histories(store.flows))
    assert text.count("WindowGroupLimit") == 2
    latest = plan(unpack.steps_by_number(store.flows.withColumn("step_number", F.lit(1)), ["update_date"], sort=False))
    assert latest.count("WindowGroupLimit") == 2


@pytest.fixture
def tight(spark):
    """Thresholds so small that the hot flow of a test counts as skewed, and no broadcast."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_steps(spark, tmp_path):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else f"f{rng.randrange(2000)}", i, "FAILED", rng.randrange(99)) for i in range(40000)]
    df = spark.createDataFrame(data, "flow_id string, step_number int, step_status string, step_running_time long")
    path = str(tmp_path / "steps")
    df.repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def test_hot_flow_is_split_in_joins(spark, tmp_path, tight):
    steps = hot_steps(spark, tmp_path)
    assert "skew=true" in final_plan(series.time_shares(steps))
    taps = steps.select(
        "flow_id",
        "step_number",
        F.lit("source").alias("direction"),
        F.when(F.col("flow_id") == "hot", "/shared").otherwise(F.col("step_number").cast("string")).alias("path"),
    ).unionByName(
        spark.createDataFrame([("hot", 1, "sink", "/shared")], "flow_id string, step_number int, direction string, path string")
    )
    edges = lineage.lineage_edges(taps)
    assert "skew=true" in final_plan(edges)
    assert edges.count() == steps.filter("flow_id = 'hot'").count()


def test_configured_hosts_move_no_rows(spark):
    for name in ("j5_with_cluster", "p5_job_listing", "f13_by_cluster", "f14_by_cluster_ci", "l3_step_links", "c5_t2_load_nodes"):
        text = plan(entry_module.queries()[name](spark, SMALL))
        assert "hashpartitioning(jt_url" not in text, name


def test_one_scan_for_each_input(spark):
    for name, scans in {"j9_join_words": 1, "f16_by_initial": 1, "u4_insert_edges": 2, "u5_upsert_agg": 2}.items():
        assert plan(entry_module.queries()[name](spark, SMALL)).count("FileScan") <= scans, name


def test_levels_of_a_long_chain_have_a_plan_of_the_same_size(spark):
    def leaves(n):
        chain = spark.range(n).selectExpr("'f' as flow_id", "cast(id as int) as src_stage", "cast(id + 1 as int) as dest_stage")
        return graph.dag_levels(chain)

    short, long = leaves(4), leaves(12)
    assert plan(short).count("FileScan") == plan(long).count("FileScan") == 3
    assert {(r.stage, r.level) for r in long.collect()} == {(i, i) for i in range(13)}


def test_paths_of_separate_edges_are_not_all_pairs(spark):
    edges = spark.range(200).selectExpr("'f' as flow_id", "cast(id * 2 as int) as src_stage", "cast(id * 2 + 1 as int) as dest_stage")
    sources = edges.selectExpr("flow_id", "src_stage as source")
    assert graph.shortest_paths(edges, sources).count() == 400


def rows_scanned(df) -> int:
    """Rows that the scan of a plan gave out, after row groups were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    """A store of many row groups sorted by date, whose flow ids lie anywhere."""
    ids = spark.range(60_000).repartition(1).select(F.md5(F.col("id").cast("string")).alias("flow_id"), F.col("id").alias("update_date"))
    names = {"found": ["flow_id"], "plain": []}
    for name, find in names.items():
        options = {"parquet.block.size": str(1 << 16), "parquet.page.size": str(1 << 13), "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100"}
        write_table(ids, str(tmp_path), name, "update_date", find, **options)
    wanted = ids.where("update_date = 777").first()["flow_id"]
    read = {name: select.flow_by_id(spark.read.parquet(f"{tmp_path}/{name}"), wanted) for name in names}
    assert [r["update_date"] for r in read["found"].collect()] == [777] == [r["update_date"] for r in read["plain"].collect()]
    assert rows_scanned(read["plain"]) > 40_000
    assert rows_scanned(read["found"]) < 6_000
    missing = select.flow_by_id(spark.read.parquet(f"{tmp_path}/found"), "0" * 32)
    assert missing.count() == 0 and rows_scanned(missing) < 6_000


def test_a_lookup_in_a_bucketed_store_reads_one_bucket(spark, tmp_path):
    from jobmetrics.sources.buckets import BucketedTable

    table = BucketedTable(spark, str(tmp_path / "flows"), "flow_id string, update_date bigint", ["flow_id"], 16)
    table.write(spark.range(16_000).select(F.md5(F.col("id").cast("string")).alias("flow_id"), F.col("id").alias("update_date")))
    wanted = table.read().where("update_date = 77").first()["flow_id"]
    found = select.flow_by_id(table.read(), wanted)
    assert [r["update_date"] for r in found.collect()] == [77]
    assert rows_scanned(found) < 16_000 / 16 * 1.5
