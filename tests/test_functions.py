"""Scalar functions, quirk by quirk."""

import pytest
from pyspark.sql import functions as F

from jobmetrics.functions import names, numbers, status, templates, times


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def long(x):
    return F.lit(x).cast("bigint")


@pytest.mark.parametrize(
    "size, text",
    [
        (None, "0B"),
        (0, "0B"),
        (1023, "1023B"),
        (1024, "1024B"),
        (1025, "1KB"),
        (1536, "2KB"),
        (1024**2, "1024KB"),
        (1024**2 + 1, "1MB"),
        (5 * 1024**3, "5GB"),
        (1024**5 + 1, "1PB"),
        (1024**6 + 1024**5, "1025PB"),
    ],
)
def test_pretty_bytes(spark, size, text):
    assert one(spark, numbers.pretty_bytes(long(size))) == (text,)


def test_durations(spark):
    values = [0, 999, 1000, 59_999, 61_000, 3_600_000, 360_000_000]
    got = one(spark, *[numbers.duration_text(long(v)) for v in values])
    assert got == ("0:00:00", "0:00:00", "0:00:01", "0:00:59", "0:01:01", "1:00:00", "100:00:00")


def test_duration_repair(spark):
    now = 1_700_000_000_000
    repair = lambda d: numbers.repaired_duration(long(d), now)
    assert one(spark, repair(-5), repair(now - 1000), repair(now - 172_800_000), repair(42), repair(None)) == (
        0,
        0,
        now - 172_800_000,
        42,
        0,
    )


def test_rounding_goes_up_on_halves(spark):
    assert one(spark, numbers.half_up(F.lit(-2.5)), numbers.half_up(F.lit(2.5)), numbers.half_up(F.lit(2.4))) == (-2, 3, 2)


def test_percent(spark):
    got = one(spark, *[numbers.percent(F.lit(x).cast("double")) for x in (0.12345, float("nan"), None, 1.0)])
    assert got == (12.35, 0.0, 0.0, 100.0)


def test_radius_bounds(spark):
    values = [1, 50, 51, 100, 101, 500, 1000, 5000, 10000, 50000, 100000, 100001]
    assert one(spark, *[numbers.task_radius(long(v)) for v in values]) == (5, 5, 10, 10, 20, 20, 30, 40, 50, 60, 70, 70)


def test_size_class(spark):
    values = [536870911999, 536870912000, 10995116277759, 10995116277760, None]
    assert one(spark, *[numbers.size_class(long(v)) for v in values]) == ("green", "orange", "orange", "red", "green")


def test_locality_without_maps_is_null(spark):
    assert one(spark, numbers.locality_percent(long(1), long(0)), numbers.locality_percent(long(1), long(3))) == (None, 33)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = one(spark, times.date_text(long(1234567890123)), times.date_text(long(0)), times.chart_label(long(1234567890123)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ("02-13-2009 23:31:30 UTC", "", "Feb 13, 2009 23:31:30")


def test_statuses(spark):
    colors = one(spark, *[status.flow_color(F.lit(x)) for x in ("RUNNING", "FAILED", "STARTED", "KILLED")])
    assert colors == ("green", "red", "black", "black")
    assert one(spark, status.flow_tip_color(F.lit("STOPPED")), status.flow_tip_color(F.lit("FAILED"))) == ("white", "red")
    assert one(spark, status.mood(F.lit("SUBMITTED")), status.mood(F.lit("PENDING"))) == ("happy", "skeptical")
    assert one(spark, status.cycle_class(F.lit(5), F.lit("KILLED"))) == ("color-cycle-red-3",)
    assert one(spark, status.is_failing(F.lit("STOPPED")), status.is_failing(F.lit("PENDING"))) == (True, False)
    assert one(spark, status.time_text(F.lit(2), F.lit("STARTED"), F.lit(9)), status.time_text(F.lit(2), F.lit("FAILED"), F.lit(9))) == (
        "Step 2: Unknown",
        "Step 2: 9 secs",
    )


def test_group_names(spark):
    raw = ["org.apache.hadoop.org.apache.hadoop.mapreduce.JobCounter", "a.B$C$D", "x.org.apache.hadoop.y", "org.apache.hadoop.A$B"]
    assert one(spark, *[names.clean_group(F.lit(x)) for x in raw]) == ("mapreduce.JobCounter", "a.B", "x.org.apache.hadoop.y", "A")


def test_prefix_is_removed_once_and_anywhere(spark):
    got = one(spark, *[names.without_prefix(F.lit(x), "a.b") for x in ("a.b.c", "x.a.b.a.b", "axb")])
    assert got == (".c", "x..a.b", "axb")


@pytest.mark.parametrize(
    "args, date",
    [
        (None, "Unknown"),
        ("--input x", "None"),
        ("--date 2020_01_02", "2020-01-02"),
        ("--date 2020_01_02 2020_01_03 --x", "2020-01-02 - 2020-01-03"),
        ("--date 2020_01_02 --x y", "2020-01-02"),
        ("--date 2020_01_02 2020_01_03 --daily", "2020-01-02"),
        ("--daily --date 2020_01_02", "2020-01-02"),
    ],
)
def test_job_date(spark, args, date):
    assert one(spark, names.job_date(names.args_array(F.lit(args).cast("string")))) == (date,)


def test_addresses(spark):
    assert one(spark, names.host_of(F.lit("h:1")), names.port_of(F.lit("h:1")), names.port_of(F.lit("h"))) == ("h", "1", None)
    assert one(spark, names.manager_host(F.lit(":80")), names.manager_host(F.lit("h:80"))) == (":80", "h")


def test_labels_and_ids(spark):
    got = one(spark, *[names.split_label(F.lit(x)) for x in ("11_AB", "11", "1_2_3", "x_AB")])
    assert [tuple(x) for x in got] == [(11, "AB"), (-1, "ERROR"), (-1, "ERROR"), (-1, "ERROR")]
    assert one(spark, *[names.valid_flow_id(F.lit(x)) for x in ("BEEFcafe12", "xyz", "", "AB\n")]) == (True, False, False, False)
    assert one(spark, names.application_id(F.lit("job_1_job_2"))) == ("application_1_job_2",)


def test_csv_list(spark):
    assert one(spark, names.csv_list(F.lit(" a, ,b ,, c d")), names.csv_list(F.lit(None).cast("string"))) == (["a", "b", "c d"], [])


def test_words_keep_empty_first_word(spark):
    assert one(spark, names.words(F.lit("  It's 2 O'Clock\tnow-ish!"))) == (["", "its", "2", "oclock", "nowish"],)


def test_templates_take_keys_and_texts_as_they_are(spark):
    values = {"a.b": F.lit("x\u0001p\u0002%")}
    texts = ["%{axb}|%{a.b}", "\u0001\u0001p`%\u0002"]
    assert one(spark, *[templates.fill_named(F.lit(t), values) for t in texts]) == ("|x\u0001p\u0002%", "\u0001\u0001p%\u0002")


def test_templates(spark):
    user = {"user": F.lit("50%{job}"), "job": F.lit("j")}
    got = one(
        spark,
        templates.fill_named(F.lit("a/%{user}/%{job}/%{none}/`%{user}/%{open"), user),
        templates.fill_fixed("a/%{user}/%{job}/%{none}/`%{user}/%{open", user),
        templates.fill_positional(F.lit("%-%-`%-%"), [F.lit("x%y"), F.lit("z")]),
    )
    assert got == ("a/50%{job}/j//%{user}/%{open", "a/50%{job}/j//%{user}/%{open", "x%y-z-%-")


def test_last_matching_rule_wins(spark):
    rules = [("^c-([0-9]+)", "first $1"), ("^c-(1)([0-9])", "$2$1/$&/$1"), ("^zzz", "never")]
    got = one(spark, *[templates.regex_map(F.lit(h), rules, F.lit("none")) for h in ("c-12-x", "c-27", "d")])
    assert got == ("21/c-12/$1", "first 27", "none")
