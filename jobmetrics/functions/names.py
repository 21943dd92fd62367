"""Names, hosts, arguments and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
NO_JOB_ID = "NO_JOB_ID"
NOT_YARN = "false"
DEFAULT_TMP_DIR = "/tmp/cache"


def clean_group(name: Column) -> Column:
    """Counter group without its package prefix (however often repeated) and without inner-class names."""
    return F.regexp_replace(F.regexp_replace(name, r"^(org\.apache\.hadoop\.)+", ""), r"(?s)\$.*$", "")


def without_prefix(name: Column, prefix: str) -> Column:
    """Remove the first occurrence of ``prefix``, wherever it stands."""
    if not prefix:
        return name
    at = F.instr(name, prefix)
    rest = F.concat(F.substr(name, F.lit(1), at - 1), F.substr(name, at + len(prefix)))
    return F.when(at > 0, rest).otherwise(name)


def user_link(user: Column, template: str | None) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    return F.replace(F.lit(template), F.lit("${username}"), user)


def args_array(args: Column) -> Column:
    return F.split(args, r"\s+")


def job_date(args: Column) -> Column:
    """Value, or pair of values, after ``--date``. ``--daily`` asks for the first one only."""
    at = F.array_position(args, "--date")
    first = F.replace(F.try_element_at(args, (at + 1).cast("int")), F.lit("_"), F.lit("-"))
    raw_second = F.try_element_at(args, (at + 2).cast("int"))
    second = F.when(~raw_second.contains("--"), F.replace(raw_second, F.lit("_"), F.lit("-")))
    return (
        F.when(args.isNull(), "Unknown")
        .when(at == 0, "None")
        .when(F.array_contains(args, "--daily") | second.isNull(), first)
        .otherwise(F.concat(first, F.lit(" - "), second))
    )


def host_of(address: Column) -> Column:
    return F.substring_index(address, ":", 1)


def port_of(address: Column) -> Column:
    """Second part of ``host:port``; null when there is none."""
    return F.get(F.split(address, ":"), 1)


def manager_host(address: Column) -> Column:
    """Host part, but an address that starts with a colon is kept whole."""
    return F.when(F.instr(address, ":") > 1, F.substring_index(address, ":", 1)).otherwise(address)


def first_setting(*settings: Column) -> Column:
    return F.coalesce(*settings, F.lit(UNKNOWN))


def csv_list(setting: Column) -> Column:
    """Trimmed, non-empty entries of a comma-separated setting."""
    entries = F.transform(F.split(F.coalesce(setting, F.lit("")), ","), lambda entry: F.trim(entry))
    return F.filter(entries, lambda entry: entry != "")


def path_or_unknown(path: Column) -> Column:
    return F.coalesce(path, F.lit(UNKNOWN))


def split_label(label: Column) -> Column:
    """``number_id`` as a struct; anything else is (-1, ERROR)."""
    parts = F.split(label, "_")
    number = parts[0].try_cast("int")
    fine = (F.size(parts) == 2) & number.isNotNull()
    return F.struct(
        F.when(fine, number).otherwise(F.lit(-1)).alias("stage"),
        F.when(fine, parts[1]).otherwise(F.lit("ERROR")).alias("step_id"),
    )


def dashed(name: Column) -> Column:
    """Job name as links need it."""
    return F.translate(name, ".", "-")


def application_number(job_id: Column) -> Column:
    return F.substr(job_id, F.lit(5))


def application_id(job_id: Column) -> Column:
    """Only the first ``job_`` is replaced."""
    return F.regexp_replace(job_id, r"^((?:(?!job_).)*)job_", "$1application_")


def valid_flow_id(flow_id: Column) -> Column:
    return F.coalesce(flow_id.rlike(r"^[A-Fa-f0-9]+\z"), F.lit(False))


def words(line: Column) -> Column:
    """Lower-case words of a line, split at whitespace after dropping all but a-z, 0-9 and whitespace."""
    return F.split(F.regexp_replace(F.lower(line), r"[^a-z0-9\s]", ""), r"\s+")
