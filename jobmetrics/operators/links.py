"""Links of steps and flows, and the report on failing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmetrics.functions import names
from jobmetrics.functions.status import COMPLETED, is_failing
from jobmetrics.functions.templates import fill_named
from jobmetrics.operators.cluster import ServerConfig, link, link_host

# Service ports.
HISTORY_PORT, APPLICATION_PORT, LEGACY_PORT = "19888", "8088", "50030"
CLIENT_LOGS = "Client Logs"


_ENTRY = "struct<name:string,url:string,custom:string>"


def _entry(name: str, url: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), url.alias("url"), F.lit(None).cast("string").alias("custom"))


def _link_rows(df: DataFrame, fixed: list[Column], text: str, values: dict[str, Column], keep: list[str]) -> DataFrame:
    """Rows (keep..., name, url): the ``fixed`` links that are not null, and the entries ``name|template`` of the
    list ``text``, which is split at semicolons. Entries of another shape are left out.

    Templates are filled after the entries have become rows, where the expressions are compiled.
    """
    entries = F.transform(
        F.split(text, ";"), lambda x: F.struct(F.lit(None).alias("name"), F.lit(None).alias("url"), x.alias("custom")).cast(_ENTRY)
    )
    none = F.array().cast(f"array<{_ENTRY}>")
    fixed_links = F.array_compact(F.array(*fixed)) if fixed else none
    rows = df.select("*", F.explode(F.concat(fixed_links, F.coalesce(entries, none))).alias("l"))
    pair = F.split("l.custom", r"\|")
    rows = rows.filter(F.col("l.custom").isNull() | (F.size(pair) == 2))
    name = F.coalesce("l.name", F.replace(pair[0], F.lit("+"), F.lit(" ")))
    url = F.coalesce("l.url", F.concat(F.lit("//"), fill_named(pair[1], values)))
    return rows.select(*keep, name.alias("name"), url.alias("url"))


def _values(with_stage: bool) -> dict[str, Column]:
    values = {"user": F.col("user_name"), "job_name": names.dashed(F.col("truncated_name")), "flow_id": F.col("flow_id")}
    return {**values, "stage": F.col("step_number")} if with_stage else values


_FLOW_FIELDS = ["flow_id", "flow_status", "user_name", "truncated_name", "jt_url", "yarn_job_history"]


def step_links(steps: DataFrame, flows: DataFrame, config: ServerConfig = ServerConfig()) -> DataFrame:
    """Rows (flow_id, step_number, flow_status, name, url): log, application, failed-task and custom links."""
    job_id, status = F.col("job_id"), F.col("step_status")
    history_host, manager = F.col("_history_host"), F.col("_manager_host")
    number = names.application_number(job_id)
    finished = link(config, history_host, HISTORY_PORT, F.concat(F.lit("/jobhistory/job/job_"), number))
    live = link(config, history_host, APPLICATION_PORT, F.concat(F.lit("/proxy/application_"), number))
    log = F.when(status.isin(COMPLETED), finished).otherwise(live)
    attempts = F.regexp_replace(finished, r"^(.*?)/job/", "$1/attempts/")
    app = link(config, manager, APPLICATION_PORT, F.concat(F.lit("/cluster/app/"), names.application_id(job_id)))
    legacy_path = F.concat(F.lit("/jobdetails.jsp?jobid="), job_id, F.lit("&refresh=0"))
    legacy = link(config, manager, LEGACY_PORT, legacy_path, "http://")

    launched = job_id.isNotNull() & (job_id != names.NO_JOB_ID)
    yarn = launched & (F.col("yarn_job_history") != names.NOT_YARN)
    failed = yarn & (status == "FAILED")
    fixed = [
        F.when(yarn, _entry("View Hadoop Logs", log)),
        F.when(failed & (F.col("failed_map_tasks") > 0), _entry("Failed Map Tasks", F.concat(attempts, F.lit("/m/FAILED")))),
        F.when(
            failed & (F.col("failed_reduce_tasks") > 0),
            _entry("Failed Reduce Tasks", F.concat(attempts, F.lit("/r/FAILED"))),
        ),
        F.when(yarn, _entry("ApplicationMaster", app)),
        F.when(launched & ~yarn, _entry("View Hadoop Logs", legacy)),
    ]
    wanted = ["flow_id", "step_number", "step_status", "job_id", "failed_map_tasks", "failed_reduce_tasks", "extra_links"]
    hosts = {
        "_history_host": link_host(config, names.host_of(F.col("yarn_job_history"))),
        "_manager_host": link_host(config, names.host_of(F.col("jt_url"))),
    }
    joined = steps.select(*wanted).join(flows.select(*_FLOW_FIELDS).withColumns(hosts), "flow_id")
    return _link_rows(joined, fixed, "extra_links", _values(True), ["flow_id", "step_number", "flow_status"])


def flow_links(flows: DataFrame) -> DataFrame:
    """Custom links of the flows themselves."""
    return _link_rows(flows, [], "flow_links", _values(False), ["flow_id"])


def failure_links(steps: DataFrame, flows: DataFrame, config: ServerConfig = ServerConfig()) -> DataFrame:
    """For runs that need attention: pages of failed tasks, else the client logs.

    Which flows have pages of failed tasks is one row each; the logs of the others are found against these.
    """
    failing = flows.filter(is_failing(F.col("flow_status")))
    # Only failed steps with failed tasks can give a link here.
    broken = steps.filter(
        (F.col("step_status") == "FAILED") & ((F.col("failed_map_tasks") > 0) | (F.col("failed_reduce_tasks") > 0))
    ).withColumn("extra_links", F.lit(None).cast("string"))
    tasks = step_links(broken, failing, config).filter(F.col("name").isin("Failed Map Tasks", "Failed Reduce Tasks"))
    tasks = tasks.select(
        "flow_id", F.concat(F.col("name"), F.lit(" for Step "), F.col("step_number").cast("string")).alias("name"), "url"
    )
    logs = flow_links(failing).filter(F.col("name") == CLIENT_LOGS)
    logs = logs.groupBy("flow_id", "name").agg(F.min("url").alias("url"))
    return tasks.unionByName(logs.join(tasks.select("flow_id").distinct(), "flow_id", "left_anti"))
