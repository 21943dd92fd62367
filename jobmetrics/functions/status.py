"""Status vocabulary: groups, predicates, colours and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The status groups.
RUNNING = ["RUNNING", "SUBMITTED", "STARTED"]
COMPLETED = ["STOPPED", "FAILED", "SUCCESSFUL", "SKIPPED"]
FINISHED = ["STOPPED", "FAILED", "SUCCESSFUL"]
HEALTHY = ["RUNNING", "SUBMITTED", "SUCCESSFUL", "PENDING", "STARTED", "SKIPPED"]
UNTIMED = ["PENDING", "SUBMITTED", "STARTED", "NOT_LAUNCHED"]


def is_finished(status: Column) -> Column:
    return status.isin(FINISHED)


def is_failing(status: Column) -> Column:
    return ~status.isin(HEALTHY)


def flow_color(status: Column) -> Column:
    return (
        F.when(status.isin("RUNNING", "SUBMITTED", "SUCCESSFUL"), "green")
        .when(status == "FAILED", "red")
        .otherwise("black")
    )


def flow_tip_color(status: Column) -> Column:
    """The same, readable on a dark ground."""
    return F.when(flow_color(status) == "black", "white").otherwise(flow_color(status))


def step_color(status: Column) -> Column:
    return (
        F.when(status.isin("RUNNING", "SUBMITTED"), "orange")
        .when(status == "SUCCESSFUL", "lightgreen")
        .when(status == "FAILED", "red")
        .otherwise("lightgray")
    )


def cycle_class(step_number: Column, status: Column) -> Column:
    """Colour class that changes from step to step inside one status."""
    color = (
        F.when(status == "RUNNING", "orange")
        .when(status.isin("FAILED", "KILLED"), "red")
        .when(status == "SUCCESSFUL", "green")
        .otherwise("grey")
    )
    return F.concat(F.lit("color-cycle-"), color, F.lit("-"), (step_number % 3 + 1).cast("string"))


def mood(status: Column) -> Column:
    """Picture shown for a step; SUBMITTED counts as running."""
    return (
        F.when(status.isin("RUNNING", "SUBMITTED", "SUCCESSFUL"), "happy")
        .when(status == "FAILED", "sad")
        .otherwise("skeptical")
    )


def status_text(step_number: Column, status: Column) -> Column:
    return F.concat(F.lit("Step "), step_number.cast("string"), F.lit(": "), status)


def time_text(step_number: Column, status: Column, running_time: Column) -> Column:
    head = F.concat(F.lit("Step "), step_number.cast("string"), F.lit(": "))
    return F.when(status.isin(UNTIMED), F.concat(head, F.lit("Unknown"))).otherwise(
        F.concat(head, running_time.cast("string"), F.lit(" secs"))
    )
