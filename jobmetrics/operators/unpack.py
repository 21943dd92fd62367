"""From stored documents to typed columns, and simple row shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmetrics.functions import names
from jobmetrics.functions.numbers import duration_text, half_up
from jobmetrics.functions.times import date_text
from jobmetrics.operators.cluster import ServerConfig, describe_flows
from jobmetrics.operators.skew import latest_per_key
from jobmetrics.schemas import FLOW_DOC, NULLABLE_COUNTERS, STEP_COUNTERS, STEP_DOC, TOTAL_ONLY_COUNTERS

# Settings of the tracker itself start with a prefix that the deployment chooses.
TRACKER_PREFIX = "tracker."
LINKS_KEY = "additional.links"
DESCRIPTION_KEY = "scalding.step.descriptions"


def counter(counters: Column, group: str, name: str, default: int | None = 0) -> Column:
    """Counter value; absent or 0 gives the default."""
    value = F.nullif(counters[group][name], F.lit(0))
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def unpack_flows(flows: DataFrame, config: ServerConfig, mapping: DataFrame | None = None) -> DataFrame:
    """Parse flow_json. Key columns replace the fields of the document, but for the status."""
    keys = ["flow_id", "flow_name", "create_date", "update_date"]
    parsed = flows.select(*keys, F.from_json("flow_json", FLOW_DOC).alias("doc"))
    fields = [F.col(f"doc.{f.name}") for f in FLOW_DOC if f.name not in keys]
    return describe_flows(parsed.select(*keys, *fields), config, mapping)


def _wanted(totals: bool) -> dict[str, tuple[str, str]]:
    return {**STEP_COUNTERS, **TOTAL_ONLY_COUNTERS} if totals else STEP_COUNTERS


def _tracked(totals: bool) -> T.StructType:
    """A step's document with the tracked counters as fields, in place of a map of all."""
    groups: dict[str, T.StructType] = {}
    for group, key in _wanted(totals).values():
        groups.setdefault(group, T.StructType()).add(key, T.LongType())
    counters = T.StructType([T.StructField(group, fields) for group, fields in groups.items()])
    return T.StructType([T.StructField("counters", counters) if f.name == "counters" else f for f in STEP_DOC])


def counter_columns(steps: DataFrame, totals: bool = False, counters: str = "counters") -> DataFrame:
    """Step columns from the counters map (or struct); ``totals`` adds those that only the totals of a flow need."""
    columns = {
        name: counter(F.col(counters), group, key, None if name in NULLABLE_COUNTERS else 0)
        for name, (group, key) in _wanted(totals).items()
    }
    out = steps.withColumns(columns)
    return out.withColumns(
        {
            "map_vcore_secs": half_up(F.col("map_vcore_millis") / 1000),
            "reduce_vcore_secs": half_up(F.col("reduce_vcore_millis") / 1000),
        }
    )


def unpack_steps(steps: DataFrame, totals: bool = False) -> DataFrame:
    """Parse step_json into columns and read the tracked counters, which the parser takes as fields.

    ``counters``, the map of all counters, is parsed apart, and only where it is used.
    """
    keys = ["flow_id", "create_date", "update_date"]
    parsed = steps.select(*keys, "step_json", F.from_json("step_json", _tracked(totals)).alias("doc"))
    every = F.from_json("step_json", T.StructType([STEP_DOC["counters"]]))["counters"]
    fields = [F.col(f"doc.{name}") for name in STEP_DOC.names if name != "counters"]
    parsed = parsed.select(*keys, *fields, every.alias("counters"), F.col("doc.counters").alias("_tracked"))
    parsed = parsed.withColumn(
        "config_props", F.coalesce("config_props", F.from_json(F.lit("{}"), "map<string,string>"))
    )
    return counter_columns(parsed, totals, "_tracked").drop("_tracked")


def steps_by_number(steps: DataFrame, order: Sequence[str], sort: bool = True) -> DataFrame:
    """One row per (flow, step number), the last in ``order``, ascending by step number."""
    kept = latest_per_key(steps, ["flow_id", "step_number"], order)
    return kept.orderBy("flow_id", "step_number") if sort else kept


def job_listing(flows: DataFrame, progress: Column) -> DataFrame:
    """The listing of runs. Needs the columns of ``describe_flows``."""
    return flows.select(
        "flow_id",
        F.col("truncated_name").alias("job_name"),
        "user_name",
        "cluster_name",
        "flow_status",
        "total_stages",
        names.job_date(F.col("args")).alias("job_date"),
        duration_text(F.col("flow_duration")).alias("running_time"),
        date_text(F.col("flow_start_epoch_ms")).alias("start_time"),
        date_text(F.col("flow_end_epoch_ms")).alias("end_time"),
        F.when(F.col("flow_status") == "SUCCESSFUL", 100.0).otherwise(progress).alias("progress"),
        "create_date",
    )


def counter_rows(steps: DataFrame) -> DataFrame:
    """One row per step, counter group and counter."""
    groups = steps.select("flow_id", "step_id", F.explode("counters").alias("group_name", "group_counters"))
    return groups.select("flow_id", "step_id", "group_name", F.explode("group_counters").alias("counter_name", "value"))


def counter_values(rows: DataFrame, seq: str) -> DataFrame:
    """Counter rows (step_id, group_name, counter_name, value) with clean group names, the last by ``seq`` of a repeated one."""
    cleaned = rows.withColumn("group_name", names.clean_group(F.col("group_name")))
    return cleaned.groupBy("step_id", "group_name", "counter_name").agg(F.max_by("value", seq).alias("value"))


def select_props(df: DataFrame, wanted: Sequence[str], default: str = names.UNKNOWN) -> DataFrame:
    """Only the named settings, ``default`` where one is absent."""
    entries = [part for name in wanted for part in (F.lit(name), F.coalesce(F.col("config_props")[name], F.lit(default)))]
    return df.withColumn("config_props", F.create_map(*entries))


def descriptions(steps: DataFrame) -> DataFrame:
    return steps.withColumn("description", F.coalesce(F.col("config_props")[DESCRIPTION_KEY], F.lit("")))


def step_settings(steps: DataFrame, prefix: str = TRACKER_PREFIX) -> DataFrame:
    """Columns description and extra_links from the settings of the steps, as links and graph rows need them."""
    return descriptions(steps).withColumn("extra_links", F.col("config_props")[prefix + LINKS_KEY])


def word_columns(words: DataFrame, word: str, count: str) -> DataFrame:
    """Rename the columns of a word list and make the count a long."""
    return words.withColumnsRenamed({"word": word, "count": count}).withColumn(count, F.col(count).cast("bigint"))


def flow_defaults(flows: DataFrame, fallback_user: str, prefix: str = TRACKER_PREFIX) -> DataFrame:
    """Flow columns from its settings (map ``config_props``), with the defaults of a new flow."""
    prop = F.col("config_props")
    return flows.withColumns(
        {
            "jt_url": names.manager_host(
                names.first_setting(prop["yarn.resourcemanager.webapp.address"], prop["mapred.job.tracker"])
            ),
            "user_name": F.coalesce(prop[prefix + "custom.user.name"], F.lit(fallback_user)),
            "tmp_dir": F.coalesce(prop["hadoop.tmp.dir"], F.lit(names.DEFAULT_TMP_DIR)),
            "yarn_job_history": F.coalesce(prop["mapreduce.jobhistory.webapp.address"], F.lit(names.NOT_YARN)),
            "hdfs_working_dir": names.first_setting(prop["mapreduce.job.working.dir"]),
            "flow_links": names.first_setting(prop[prefix + "flow.links"]),
            "cascade_id": names.first_setting(F.col("cascade_id")),
        }
    )


def with_start(steps: DataFrame, starts: DataFrame, now_ms: int) -> DataFrame:
    """Running time in whole seconds since the marked start; ``starts`` has step_id and start_ms."""
    marked = starts.groupBy("step_id").agg(F.max("start_ms").alias("start_ms"))
    since = F.floor((F.lit(now_ms) - F.col("start_ms")) / 1000).cast("bigint")
    return (
        steps.join(marked, "step_id", "left")
        .withColumn("step_running_time", F.coalesce(since, F.col("step_running_time")))
        .withColumn("step_start_epoch_ms", F.coalesce("start_ms", "step_start_epoch_ms"))
        .drop("start_ms")
    )
