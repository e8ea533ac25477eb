from datetime import date, datetime

import pytest
from flowgauge.functions import time as T
from pyspark.sql import functions as F


def one(spark, **columns):
    return spark.range(1).select(*[column.alias(name) for name, column in columns.items()]).first()


def day(text):
    return F.lit(text).cast("date")


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "unit, expected",
    [("DAYS", datetime(2019, 9, 29)), ("WEEKS", datetime(2019, 9, 23)), ("MONTHS", datetime(2019, 9, 1))],
)
def test_period_start(spark, unit, expected):
    assert one(spark, x=T.period_start(unit, ts("2019-09-29 23:59:59.999")))["x"] == expected


def test_period_start_in_a_clock_change(spark):
    # 02:30 does not exist in the session zone on this day.
    assert one(spark, x=T.period_start("DAYS", ts("2020-03-08 02:30:00")))["x"] == datetime(2020, 3, 8)


def test_unknown_unit():
    with pytest.raises(ValueError):
        T.period_date("HOURS", F.lit(None))


@pytest.mark.parametrize(
    "unit, start, end, expected",
    [
        ("WEEKS", "2019-09-23", "2019-09-30", 1),
        ("WEEKS", "2019-09-23", "2019-09-29", 0),
        ("WEEKS", "2019-09-30", "2019-09-23", -1),
        ("DAYS", "2019-09-23", "2019-09-30", 7),
        ("MONTHS", "2020-01-31", "2020-02-29", 0),
        ("MONTHS", "2020-01-31", "2020-03-30", 1),
        ("MONTHS", "2020-01-31", "2020-03-31", 2),
        ("MONTHS", "2020-03-31", "2020-01-31", -2),
    ],
)
def test_complete_units(spark, unit, start, end, expected):
    assert one(spark, x=T.complete_units(unit, day(start), day(end)))["x"] == expected


def test_days_ignore_time_but_complete_days_do_not(spark):
    start, end = ts("2020-01-01 23:00:00"), ts("2020-01-02 01:00:00")
    row = one(spark, days=T.days_between(start, end), full=T.complete_units_of_time("DAYS", start, end), hours=T.hours_between(start, end))
    assert (row["days"], row["full"], row["hours"]) == (1, 0, 2)


def test_complete_months_count_the_time_of_day(spark):
    row = one(
        spark,
        before=T.complete_units_of_time("MONTHS", ts("2020-01-15 12:00:00"), ts("2020-02-15 11:59:59")),
        after=T.complete_units_of_time("MONTHS", ts("2020-01-15 12:00:00"), ts("2020-02-15 12:00:00")),
    )
    assert (row["before"], row["after"]) == (0, 1)


def test_ranges(spark):
    row = one(
        spark,
        weeks=T.date_range("WEEKS", day("2020-10-12"), day("2020-10-19")),
        none=T.date_range("WEEKS", day("2020-10-19"), day("2020-10-12")),
        single=T.date_range("WEEKS", day("2020-10-12"), day("2020-10-18")),
        months=T.date_range("MONTHS", day("2020-01-31"), day("2020-03-31")),
        short=T.date_range("MONTHS", day("2020-01-31"), day("2020-02-29")),
        missing=T.date_range("DAYS", F.lit(None), day("2020-02-29")),
    )
    assert row["weeks"] == [date(2020, 10, 12), date(2020, 10, 19)]
    assert row["none"] == [] and row["missing"] == []
    assert row["single"] == [date(2020, 10, 12)]
    assert row["months"] == [date(2020, 1, 31), date(2020, 2, 29), date(2020, 3, 31)]
    assert row["short"] == [date(2020, 1, 31)]


def test_names_of_days_and_weeks(spark):
    row = one(spark, name=T.weekday_name(day("2019-09-29")), week=T.iso_week_number(day("2021-01-03")))
    assert (row["name"], row["week"]) == ("SUNDAY", 53)


@pytest.mark.parametrize(
    "text, wall, instant",
    [
        ("2019-08-05T10:19:50.000+0200", datetime(2019, 8, 5, 10, 19, 50), datetime(2019, 8, 5, 8, 19, 50)),
        ("2019-08-05T10:19:50.123-05:00", datetime(2019, 8, 5, 10, 19, 50, 123000), datetime(2019, 8, 5, 15, 19, 50, 123000)),
        ("2019-08-05T10:19:50Z", datetime(2019, 8, 5, 10, 19, 50), datetime(2019, 8, 5, 10, 19, 50)),
        ("2019-08-05T10:19:50+02:00[Europe/Paris]", datetime(2019, 8, 5, 10, 19, 50), datetime(2019, 8, 5, 8, 19, 50)),
    ],
)
def test_parsing(spark, text, wall, instant):
    row = one(spark, w=T.parse_time(F.lit(text)), i=T.parse_time(F.lit(text), "instant"), ms=T.parse_epoch_millis(F.lit(text)))
    assert row["w"] == wall
    assert row["i"] == instant
    assert row["ms"] == round((instant - datetime(1970, 1, 1)).total_seconds() * 1000)


def test_epoch_round_trip(spark):
    row = one(
        spark,
        ms=T.time_to_epoch_millis(ts("2020-03-08 02:30:00.123")),
        back=T.epoch_millis_to_time(F.lit(1583634600123)),
        early=T.epoch_millis_to_time(F.lit(-1)),
    )
    assert row["ms"] == 1583634600123
    assert row["back"] == datetime(2020, 3, 8, 2, 30, 0, 123000)
    assert row["early"] == datetime(1969, 12, 31, 23, 59, 59, 999000)


def test_missing_end_is_the_report_time(spark):
    row = one(spark, x=T.or_as_of(F.lit(None).cast("timestamp_ntz"), "2020-01-01 10:00:00"))
    assert row["x"] == datetime(2020, 1, 1, 10)


def test_spans_keep_time_order(spark):
    row = one(spark, a=T.time_span(ts("2020-01-01 09:59:59"), 60), b=T.time_span(ts("2020-01-01 10:00:00"), 60))
    assert row["b"] == row["a"] + 1
