"""Settings the registered queries run with, and their form in check SQL."""

from __future__ import annotations

from jobmetrics.operators.cluster import ServerConfig

HOST_RULE = r"^rm([0-9]+)\.example\.com$"
LATE_RULE = r"^rm[45]\.(\w+)"
HISTORY_RULE = r"^jh([0-9]+)\.(.*)$"

CONFIG = ServerConfig(
    cluster_name_mapping={"rm0.example.com": "Alpha", "rm1.example.com": "Beta", "rm2.example.com": "Alpha"},
    cluster_name_regexes=[(HOST_RULE, "cluster-$1"), (LATE_RULE, "$1/$&")],
    job_name_prefix="com.example.",
    username_link_format="https://people.example.com/${username}?u=${username}",
    cluster_link_host_regexes=[(HISTORY_RULE, "history-$1.$2")],
)

RULE_NAME_SQL = f"""case when regexp_matches(jt_url, '{LATE_RULE}')
        then regexp_extract(jt_url, '{LATE_RULE}', 1) || '/' || regexp_extract(jt_url, '{LATE_RULE}', 0)
    when regexp_matches(jt_url, '{HOST_RULE}') then 'cluster-' || regexp_extract(jt_url, '{HOST_RULE}', 1)
    else 'Unknown' end"""

CLUSTER_SQL = f"""case when jt_url in ('rm0.example.com', 'rm2.example.com') then 'Alpha'
    when jt_url = 'rm1.example.com' then 'Beta' else {RULE_NAME_SQL} end"""

DESCRIBED = f"""select *, {CLUSTER_SQL} as cluster_name,
    'https://people.example.com/' || user_name || '?u=' || user_name as username_link,
    substr(flow_name, 13) as truncated_name, regexp_split_to_array(job_args, '\\s+') as args from flows"""


def bytes_sql(x: str) -> str:
    x = f"coalesce({x}, 0)"
    cases = [f"when {x} <= 1024 then cast({x} as bigint) || 'B'"]
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        cases.append(f"when {x} <= 1024 ** {power + 1} then cast(floor({x} / (1024 ** {power}) + 0.5) as bigint) || '{unit}'")
    return f"(case {' '.join(cases)} else cast(floor({x} / (1024 ** 5) + 0.5) as bigint) || 'PB' end)"


def round_sql(x: str) -> str:
    return f"cast(floor({x} + 0.5) as bigint)"


def giga_sql(x: str) -> str:
    return round_sql(f"coalesce({x}, 0) / 1073741824")


def duration_sql(ms: str) -> str:
    s = f"({ms} // 1000)"
    return f"printf('%d:%02d:%02d', {s} // 3600, ({s} // 60) % 60, {s} % 60)"


def utc_sql(ms: str, form: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '{form}')"


def date_sql(ms: str) -> str:
    return f"case when {ms} = 0 then '' else {utc_sql(ms, '%m-%d-%Y %H:%M:%S UTC')} end"


def size_class_sql(x: str) -> str:
    return f"case when {x} >= 10995116277760 then 'red' when {x} >= 536870912000 then 'orange' else 'green' end"


FLOW_COLOR_SQL = """case when flow_status in ('RUNNING', 'SUBMITTED', 'SUCCESSFUL') then 'green'
    when flow_status = 'FAILED' then 'red' else 'black' end"""
STEP_COLOR_SQL = """case step_status when 'RUNNING' then 'orange' when 'SUBMITTED' then 'orange'
    when 'SUCCESSFUL' then 'lightgreen' when 'FAILED' then 'red' else 'lightgray' end"""
MOOD_SQL = """case step_status when 'RUNNING' then 'happy' when 'SUBMITTED' then 'happy' when 'SUCCESSFUL' then 'happy'
    when 'FAILED' then 'sad' else 'skeptical' end"""
