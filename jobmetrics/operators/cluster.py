"""Server configuration and the flow columns that depend on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmetrics.functions.names import args_array, user_link, without_prefix
from jobmetrics.functions.templates import fill_fixed, regex_map

DEFAULT_LINK = "%{schemeWithSlashes}%{host}:%{port}%{path}"
ARGS_KEY = "scalding.job.args"


@dataclass(frozen=True)
class ServerConfig:
    cluster_name_mapping: Mapping[str, str] = field(default_factory=dict)
    cluster_name_regexes: Sequence[tuple[str, str]] = ()
    job_name_prefix: str = ""
    username_link_format: str | None = None
    cluster_link_host_regexes: Sequence[tuple[str, str]] = ()
    cluster_link_template: str = DEFAULT_LINK


def clusters(mapping: DataFrame) -> DataFrame:
    """Distinct cluster names of a (host, cluster_name) table."""
    return mapping.select("cluster_name").distinct()


def with_cluster(flows: DataFrame, config: ServerConfig, mapping: DataFrame | None = None) -> DataFrame:
    """Add cluster_name: exact host lookup, else the regex rules, else ``Unknown``. An empty name counts as none.

    The configured hosts are part of the plan, so no row moves for them; ``mapping`` may replace them by a (host,
    cluster_name) table of any size, which is joined.
    """
    by_rule = regex_map(F.col("jt_url"), config.cluster_name_regexes, F.lit("Unknown"))
    if mapping is None:
        if not config.cluster_name_mapping:
            return flows.withColumn("cluster_name", by_rule)
        hosts = F.create_map(*[F.lit(x) for pair in config.cluster_name_mapping.items() for x in pair])
        return flows.withColumn("cluster_name", F.coalesce(F.nullif(F.try_element_at(hosts, F.col("jt_url")), F.lit("")), by_rule))
    known = mapping.filter(F.col("cluster_name") != "").select(F.col("host").alias("jt_url"), "cluster_name")
    return flows.join(known, "jt_url", "left").withColumn("cluster_name", F.coalesce("cluster_name", by_rule))


def describe_flows(flows: DataFrame, config: ServerConfig, mapping: DataFrame | None = None) -> DataFrame:
    """Add cluster_name, username_link, truncated_name and the array args."""
    args = F.col("config_props")[ARGS_KEY] if "config_props" in flows.columns else F.col("job_args")
    return with_cluster(flows, config, mapping).withColumns(
        {
            "username_link": user_link(F.col("user_name"), config.username_link_format),
            "truncated_name": without_prefix(F.col("flow_name"), config.job_name_prefix),
            "args": args_array(args),
        }
    )


def link_host(config: ServerConfig, host: Column) -> Column:
    """The host as links name it."""
    return regex_map(host, config.cluster_link_host_regexes, host)


def link(config: ServerConfig, host: Column, port: str, path: Column, scheme: str = "//") -> Column:
    """A link to a ``link_host``."""
    return fill_fixed(
        config.cluster_link_template,
        {
            "schemeWithSlashes": F.lit(scheme),
            "host": host,
            "port": F.lit(port),
            "path": path,
        },
    )
