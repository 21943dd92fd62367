"""Queries: JSON feeds and stores (S1-S5), streams (R)."""

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from jobmetrics.operators import totals, unpack
from jobmetrics.operators.cluster import ARGS_KEY
from jobmetrics.operators.series import history_series
from jobmetrics.plans.functions import counters_struct
from jobmetrics.plans.registry import query
from jobmetrics.plans.series import history_sql
from jobmetrics.plans.settings import CONFIG, DESCRIBED
from jobmetrics.plans.states import CHANGED, CHANGED_SQL, STEP_STATE_SQL
from jobmetrics.plans.tables import AGG_COLUMNS, ARRIVAL, FLOW_COLUMNS, STEP_COLUMNS, Tables
from jobmetrics.plans.totals import LISTING_SQL, PROGRESS_SQL
from jobmetrics.runtime import scratch_path
from jobmetrics.schemas import AGG_DOC, FLOW_DOC
from jobmetrics.sources import feeds
from jobmetrics.sources.ingest import empty_store, ingest, write_store
from jobmetrics.sources.store import TableNames, load_store, write_table
from jobmetrics.streaming import feeds as streams


def envelope(df, body, received, seq, *more):
    return df.select("flow_id", received.alias("received"), seq.cast("bigint").alias("seq"), body.alias("body"), *more)


def posted(t, df, name):
    """Write envelopes as gzipped JSON lines and give the path; readers take them by their extension. They are read once and
    dropped, so the fastest level is enough."""
    path = scratch_path(t.spark, name)
    df.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(path)
    return path


#: Input bytes of a feed's part.
PART_BYTES = 32 << 20
#: Each part has fixed costs, which must not add up over a large input: beyond this many, parts grow instead.
MOST_PARTS = 24
#: Parts at work at a time, so that one part's last tasks leave no cores idle.
IN_FLIGHT = 2


def part_count(t, *dfs):
    """One part for every ``PART_BYTES`` of the files that ``dfs`` read, up to ``MOST_PARTS``."""
    conf = t.spark._jsc.hadoopConfiguration()
    size = 0
    for name in {name for df in dfs for name in df.inputFiles()}:
        path = t.spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(1, min(MOST_PARTS, -(-size // PART_BYTES)))


class Part(Tables):
    """The tables of a directory with only the rows of one part where ``split`` cut them."""

    def __init__(self, t, cut, i):
        super().__init__(t.spark, t.sf_dir)
        self.cut, self.i = cut, i

    def raw(self, name):
        if name not in self.cut:
            return super().raw(name)
        return self.cut[name][1].filter(F.col("_part") == self.i).drop("_part")

    def drop(self):
        """Delete the rows of this part."""
        removed(self, *[f"{path}/_part={self.i}" for path, _ in self.cut.values()])


def split(t, n, **keys):
    """``n`` parts of the tables named in ``keys``, by the hash of the key expression given for each. Every row is written
    to its part once, so the parts together read the input once, not each of them all of it. One part reads the tables in place."""
    if n == 1:
        return [Part(t, {}, 0)]
    cut = {}
    for name, key in keys.items():
        raw, path = t.raw(name), scratch_path(t.spark, f"split-{name}")
        raw.withColumn("_part", F.pmod(F.xxhash64(F.expr(key)), F.lit(n)).cast("int")).write.partitionBy("_part").parquet(path)
        cut[name] = path, t.spark.read.schema(f"{raw.schema.toDDL()}, _part int").parquet(path)
    return [Part(t, cut, i) for i in range(n)]


def flow_parts(t, df):
    """Parts of the steps by flow, one for every ``PART_BYTES`` that ``df`` reads."""
    return split(t, part_count(t, df), lineitem=STEP_COLUMNS["flow_id"])


def dealt_updates(t):
    """The step updates, dealt to the tasks that group them into reports. The narrow input rows are moved; the derived columns
    are computed after the shuffle."""
    lineitem = t.raw("lineitem").withColumns({"ship_epoch": t._epoch("l_shipdate"), "flow": F.expr(STEP_COLUMNS["flow_id"])})
    dealt = lineitem.repartition("flow", "ship_epoch", STEP_COLUMNS["seq_a"])
    return dealt.selectExpr(*[f"{e} as {n}" for n, e in (STEP_COLUMNS | {"flow_id": "flow"}).items()])


@contextmanager
def shuffle_files_dropped(t):
    """Shuffle files of the queries run inside are deleted as each ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = t.spark.conf.get(key, None)
    t.spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            t.spark.conf.unset(key)
        else:
            t.spark.conf.set(key, before)


def each_part(t, work, *parts):
    """Call ``work`` with the number and the tables of each part, ``IN_FLIGHT`` at a time."""
    with shuffle_files_dropped(t), ThreadPoolExecutor(IN_FLIGHT) as pool:
        for _ in pool.map(inheritable_thread_target(t.spark)(work), range(len(parts[0])), *parts):
            pass


def removed(t, *paths):
    """Delete posted feeds that nothing reads any more."""
    conf = t.spark._jsc.hadoopConfiguration()
    for name in paths:
        path = t.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@query(
    "s1_read_flow_updates",
    "select flow_id, flow_name, flow_status, user_name, flow_duration, tmp_dir, cast(flow_duration as double) as progress, "
    "job_args, update_date, flow_priority as seq from flows",
)
def _(t):
    body = F.struct(
        "flow_name", "flow_status", "user_name", "flow_duration", "tmp_dir",
        F.create_map(F.lit("flow_progress"), F.col("flow_duration")).alias("aggregated"),
        F.create_map(F.lit("args"), F.col("job_args")).alias("config_props"),
    )
    path = posted(t, envelope(t.flows, body, F.col("update_date"), F.col("flow_priority")), "flow-feed")
    return feeds.read_flow_updates(t.spark, path).select(
        "flow_id", "flow_name", "flow_status", "user_name", "flow_duration", "tmp_dir",
        totals.field_of(F.col("aggregated"), "flow_progress", "double").alias("progress"), F.col("config_props")["args"].alias("job_args"),
        "update_date", "seq",
    )


@query(
    "s2_read_step_updates",
    "select flow_id, step_id, step_number, step_status, map_progress, has_reduce_stage, cpu_millis, gs_bytes_read, "
    "seq_a as seq from step_updates",
)
def _(t):
    step = F.struct(
        "step_id", "step_number", "step_status", "map_progress", "has_reduce_stage", counters_struct(t).alias("counters")
    )
    # A report holds the steps of a flow that arrived together.
    root = scratch_path(t.spark, "step-updates")
    # Flows are posted and read part by part, so that few parts' feeds and shuffles are on disk at a time.
    columns = "flow_id", "step_id", "step_number", "step_status", "map_progress", "has_reduce_stage", "cpu_millis", "gs_bytes_read", "seq"

    def read_part(i, part):
        reports = dealt_updates(part).select("flow_id", "arrived", "seq_a", step.alias("step"))
        reports = reports.groupBy("flow_id", "arrived", "seq_a").agg(F.collect_list("step").alias("steps"))
        path = posted(t, envelope(reports, F.col("steps"), F.col("arrived"), F.col("seq_a")), "step-feed")
        part.drop()
        unpack.counter_columns(feeds.read_step_updates(t.spark, path)).select(*columns).write.parquet(f"{root}/{i}")
        removed(t, path)

    each_part(t, read_part, flow_parts(t, t.step_updates))
    return t.spark.read.parquet(f"{root}/*")


@query("s3_read_edges", "select flow_id, src_stage, dest_stage from edges")
def _(t):
    # A report holds all edges of a flow.
    targets = t.edges.groupBy("flow_id", "src_stage").agg(F.collect_list("dest_stage").alias("targets"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("src_stage").cast("string"), "targets"))).alias("body")
    path = posted(t, envelope(targets.groupBy("flow_id").agg(entries), F.col("body"), F.lit(1), F.lit(1)), "edge-feed")
    return feeds.read_edges(t.spark, path).select("flow_id", "src_stage", "dest_stage")


def agg_envelopes(t, *more):
    metrics = F.create_map(F.lit("value"), F.col("metric"), F.lit("user"), F.col("flow_id").cast("double"))
    body = F.struct("flow_id", "epoch_ms", metrics.alias("agg_json"))
    return envelope(t.agg, body, F.floor(F.col("epoch_ms") / 1000).cast("bigint"), F.col("seq"), *more)


@query("s4_read_agg", "select flow_id, epoch_ms, metric, cast(flow_id as double) as user, seq from agg")
def _(t):
    read = feeds.read_agg(t.spark, posted(t, agg_envelopes(t), "agg-feed"))
    stored = F.from_json("agg_json", AGG_DOC)["agg_json"]
    user = totals.field_of(F.col("metrics"), "user", "double").alias("user")
    return read.select("flow_id", "epoch_ms", totals.field_of(stored, "value", "double").alias("metric"), user, "seq")


@query(
    "s5_load_store",
    """select 'flows' as store, flow_id as key, concat_ws('|', flow_name, flow_status, create_date, update_date) as content from flows
    union all select 'steps', step_id, concat_ws('|', flow_id, step_status) from steps
    union all select 'edges', flow_id, concat_ws('|', src_stage, dest_stage) from edges
    union all select 'aggregates', flow_id, concat_ws('|', epoch_ms, payload, seq) from agg""",
)
def _(t):
    root, names = scratch_path(t.spark, "store"), TableNames(flows="flows_new", steps="steps_new")
    write_table(t.flows.select("flow_id", "flow_name", "flow_status", "create_date", "update_date"), root, names.flows, "create_date", ["flow_id"])
    write_table(t.steps.select("step_id", "flow_id", "step_status"), root, names.steps, find=["flow_id", "step_id"])
    write_table(t.edges, root, names.edges, find=["flow_id"])
    write_table(t.agg, root, names.aggregates, "epoch_ms", ["flow_id"])
    store = load_store(t.spark, root, names)

    def part(name, df, key, *content):
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in content])
        return df.select(F.lit(name).alias("store"), F.col(key).alias("key"), text.alias("content"))

    return (
        part("flows", store.flows, "flow_id", "flow_name", "flow_status", "create_date", "update_date")
        .unionByName(part("steps", store.steps, "step_id", "flow_id", "step_status"))
        .unionByName(part("edges", store.edges, "flow_id", "src_stage", "dest_stage"))
        .unionByName(part("aggregates", store.aggregates, "flow_id", "epoch_ms", "payload", "seq"))
    )


def broken_feed(t):
    """Snapshot reports as posted, those of kind error cut short."""
    text = F.to_json(F.struct("*"))
    head = F.concat(F.lit('{"flow_id":"'), "flow_id", F.lit('","seq":'), "seq", F.lit(',"body":{"x'))
    return agg_envelopes(t, "kind").select("seq", F.when(F.col("kind") == "error", head).otherwise(text).alias("value"))


@query(
    "r3_failure_counts",
    "select flow_id, count(*) as n_failed, count(*) < 10 as tracked from agg where kind = 'error' group by flow_id",
)
def _(t):
    path = scratch_path(t.spark, "broken-feed")
    broken_feed(t).select("value").write.text(path)
    _, rejects = feeds.split_rejects(feeds.read_feed(t.spark, path, AGG_DOC))
    return streams.failure_counts(rejects)


TOLERATED = """select a.flow_id, a.epoch_ms, a.seq from agg a left join (select flow_id, seq as stop from agg where kind = 'error'
        qualify row_number() over (partition by flow_id order by seq) = 10) s using (flow_id) left join (select x.flow_id,
        min(x.seq) as final from agg x join (select flow_id, seq as stop from agg where kind = 'error' qualify row_number() over
        (partition by flow_id order by seq) = 10) y on x.flow_id = y.flow_id and x.seq > y.stop group by all) e using (flow_id)
    where (stop is null or seq < stop or seq = final)"""


@query("r3_within_tolerance", TOLERATED)
def _(t):
    failures = t.agg.filter("kind = 'error'")
    return streams.within_tolerance(t.agg, failures, "seq").select("flow_id", "epoch_ms", "seq")


PARTS = 3
#: Of the streams' state, for tables of this size.
BUCKETS = 8


def in_parts(df, order):
    """Conditions that cut the rows into ``PARTS`` in order of arrival."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    bounds = [low + (high - low) * i // PARTS for i in range(1, PARTS)] if low is not None else []
    column = F.col(order)
    return [
        (F.lit(True) if i == 0 else column >= bounds[i - 1]) & (F.lit(True) if i == len(bounds) else column < bounds[i])
        for i in range(len(bounds) + 1)
    ]


@query("r3_tolerant_stream", TOLERATED + " and kind <> 'error'")
def _(t):
    source, out, log, checkpoint = (scratch_path(t.spark, f"tolerant-{part}") for part in ("in", "out", "log", "checkpoint"))
    lines = broken_feed(t)
    for part in in_parts(lines, "seq"):
        lines.filter(part).select("value").write.mode("append").text(source)
        feed = feeds.read_feed(t.spark, source, AGG_DOC, stream=True)
        streams.tolerant_stream(feed, out, log, checkpoint, refresh=None, buckets=BUCKETS).awaitTermination()
    kept = t.spark.read.parquet(out)
    return kept.select("flow_id", F.col("body.epoch_ms").alias("epoch_ms"), "seq")


def run_in_parts(t, rows, order, name, start):
    """Let the rows arrive part by part; ``start(stream, path)`` runs the query over what has arrived, from its checkpoint."""
    source, path = scratch_path(t.spark, f"{name}-in"), scratch_path(t.spark, name)
    for part in in_parts(rows, order):
        rows.filter(part).write.mode("append").parquet(source)
        start(t.spark.readStream.schema(rows.schema).parquet(source), path).awaitTermination()
    return path


@query("r1_r2_r4_stream_upsert", STEP_STATE_SQL)
def _(t):
    updates = t.step_updates.select(
        "flow_id", "step_id", "step_status", "map_progress", F.col("arrived").alias("update_date"), *ARRIVAL
    )

    def start(stream, path):
        return streams.upsert_stream(stream, f"{path}/log", f"{path}/checkpoint", ["step_id"], ARRIVAL, refresh=None, every=2, buckets=BUCKETS)

    path = run_in_parts(t, updates, "arrived", "step-state", start)
    return streams.read_state(t.spark, f"{path}/log", updates.schema, ["step_id"], ARRIVAL, BUCKETS).drop(*ARRIVAL)


@query("r5_stream_changes", CHANGED_SQL)
def _(t):
    month = F.floor(F.col("arrived") / (30 * 86400)).alias("month")
    updates = t.step_updates.select("step_id", "step_status", *ARRIVAL, month)

    def start(stream, path):
        return streams.changed_steps_stream(
            stream, f"{path}/out", f"{path}/log", f"{path}/checkpoint", ARRIVAL, "month", refresh=None, every=2, buckets=BUCKETS
        )

    path = run_in_parts(t, updates, "arrived", "changes", start)
    return t.spark.read.parquet(f"{path}/out").select(*CHANGED)


@query("r6_snapshot_series", "select flow_id, epoch_ms, metric, payload from agg")
def _(t):
    snapshots = t.agg.withColumn("update_date", F.col("epoch_ms"))
    keys = ["epoch_ms", "flow_id"]

    def start(stream, path):
        return streams.upsert_stream(stream, f"{path}/log", f"{path}/checkpoint", keys, ["seq"], refresh=None, every=2, buckets=BUCKETS)

    path = run_in_parts(t, snapshots, "seq", "snapshots", start)
    state = streams.read_state(t.spark, f"{path}/log", snapshots.schema, keys, ["seq"], BUCKETS)
    return state.select("flow_id", "epoch_ms", "metric", "payload")


def ingested(t):
    """All tables posted as reports, ingested into empty stores, written and loaded again."""
    step = F.struct("step_id", "step_number", "step_status", "map_progress", "has_reduce_stage", counters_struct(t).alias("counters"))
    edge = F.create_map(F.col("src_stage").cast("string"), F.array("dest_stage"))
    one = F.lit(1)
    read = (feeds.read_flow_updates, feeds.read_step_updates, feeds.read_edges, feeds.read_agg)
    root = scratch_path(t.spark, "ingested")
    # Each store has its own key, within a flow or a step; the parts are posted, ingested and stored apart, and read as one.
    n = part_count(t, t.flows, t.steps, t.step_updates, t.edges, t.agg)
    by_flow = split(t, n, orders=FLOW_COLUMNS["flow_id"], lineitem=STEP_COLUMNS["flow_id"], events=AGG_COLUMNS["flow_id"])
    by_step = split(t, n, lineitem=STEP_COLUMNS["step_id"])

    def store_part(i, flows, steps):
        updates = envelope(steps.step_updates, F.array(step), F.col("arrived"), F.col("seq_a") * 1_000_000 + F.col("seq_b"))
        paths = [
            posted(t, flow_envelopes(flows), "all-flows"),
            posted(t, updates, "all-steps"),
            posted(t, envelope(flows.edges, edge, one, one), "all-edges"),
            posted(t, agg_envelopes(flows), "all-agg"),
        ]
        flows.drop()
        steps.drop()
        write_store(ingest(empty_store(t.spark), *[r(t.spark, p) for r, p in zip(read, paths)]), f"{root}/{i}")
        removed(t, *paths)

    each_part(t, store_part, by_flow, by_step)
    return load_store(t.spark, f"{root}/*")


def flow_envelopes(t):
    """Flows as reports, each with the totals of its steps."""
    sums = totals.flow_totals(t.steps)
    kept = F.struct(*sums.columns[1:]).alias("aggregated")
    body = F.struct(
        *[c for c in FLOW_DOC.names if c in t.flows.columns and c != "flow_id"],
        "aggregated",
        F.create_map(F.lit(ARGS_KEY), F.col("job_args")).alias("config_props"),
    )
    return envelope(t.flows.join(sums.select("flow_id", kept), "flow_id", "left"), body, F.col("create_date"), F.lit(1))


@query(
    "e2e_history",
    history_sql(),
    {"runs": "select f.*, t.* exclude (flow_id) from flows f join totals t using (flow_id) where flow_status in ('STOPPED', 'FAILED', 'SUCCESSFUL')"},
)
def _(t):
    """From reports to charts; flows without steps have no aggregates, and ingest leaves them out."""
    flows = unpack.unpack_flows(ingested(t).flows.filter("flow_status in ('STOPPED', 'FAILED', 'SUCCESSFUL')"), CONFIG)
    return history_series(totals.stored_totals(flows))


@query(
    "e2e_listing",
    f"select l.* from ({LISTING_SQL}) l where flow_id in (select flow_id from steps)",
    {"described": DESCRIBED, "progress": PROGRESS_SQL},
)
def _(t):
    flows = totals.stored_totals(unpack.unpack_flows(ingested(t).flows, CONFIG))
    return unpack.job_listing(flows, F.col("flow_progress"))


@query(
    "e2e_steps",
    "select flow_id, step_id, step_number, step_status, map_progress, cpu_millis, n_edges, n_snapshots from (select *, row_number() over "
    "(partition by step_id order by arrived desc, seq_a desc, seq_b desc) as rn from step_updates) left join "
    "(select flow_id, src_stage as step_number, count(*) as n_edges from edges group by all) using (flow_id, step_number) left join "
    "(select flow_id, count(*) as n_snapshots from agg group by all) using (flow_id) where rn = 1",
)
def _(t):
    store = ingested(t)
    steps = unpack.unpack_steps(store.steps)
    edges = store.edges.groupBy("flow_id", F.col("src_stage").alias("step_number")).agg(F.count("*").alias("n_edges"))
    snapshots = store.aggregates.groupBy("flow_id").agg(F.count("*").alias("n_snapshots"))
    rows = steps.join(edges, ["flow_id", "step_number"], "left").join(snapshots, "flow_id", "left")
    return rows.select("flow_id", "step_id", "step_number", "step_status", "map_progress", "cpu_millis", "n_edges", "n_snapshots")
