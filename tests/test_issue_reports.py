from datetime import datetime, timedelta

import pytest
from flowgauge.functions.time import date_range, period_date
from flowgauge.metric_queries import rebucket_distinct
from flowgauge.operators import issue_reports as R
from pyspark.sql import functions as F

AS_OF = "2020-01-20 00:00:00"


def statuses(spark, *changes, project="p"):
    """Changes as (item, day of January, state, author)."""
    data = [
        (project, item, "Bug", "High", datetime(2020, 1, day), datetime(2020, 1, day, 9, pos % 60), state, author, None, pos)
        for pos, (item, day, state, author) in enumerate(changes)
    ]
    return spark.createDataFrame(
        data,
        "project string, id string, type string, priority string, created timestamp_ntz, statusCreated timestamp_ntz, "
        "statusName string, statusAuthor string, epicName string, pos long",
    ).withColumns({"closed": F.lit(None).cast("timestamp_ntz")})


def test_change_log_collapses_equal_points(spark, rows):
    log = R.change_log(statuses(spark, ("1", 6, "todo", None), ("1", 7, "todo", None), ("1", 14, "todo", "ann")), "WEEKS")
    assert rows(log) == [
        (datetime(2020, 1, 13), "1", "Bug", "High", "ann", "todo", "No epic", 1),
        (datetime(2020, 1, 6), "1", "Bug", "High", "", "todo", "No epic", 1),
    ]


def test_counts_by_type(spark, rows):
    items = statuses(spark, ("1", 6, "x", None), ("2", 7, "x", None), ("3", 14, "x", None))
    assert rows(R.count_by_type_priority(items, "WEEKS")) == [
        ("Bug", "High", datetime(2020, 1, 13), 1),
        ("Bug", "High", datetime(2020, 1, 6), 2),
    ]


def test_distinct_authors(spark, rows):
    changes = statuses(
        spark, ("1", 6, "Doing", "ann"), ("1", 7, "Doing", "ann"), ("2", 7, "Doing", "bob"), ("2", 8, "Done", "cy"),
        ("3", 8, "Doing", None),
    )
    assert rows(R.count_distinct_authors(changes, "WEEKS")) == [(datetime(2020, 1, 6), 2)]
    assert rows(R.count_distinct_authors(changes, "WEEKS", relative_error=0.05)) == [(datetime(2020, 1, 6), 2)]


def test_team_productivity(spark):
    # ann is there on days 1 to 4, bob on day 3, someone unknown on day 4.
    changes = statuses(
        spark, ("1", 1, "Doing", "ann"), ("2", 4, "Doing", "ann"), ("3", 3, "Doing", "bob"), ("4", 4, "Doing", None),
        ("5", 9, "Backlog", "dan"),
    )
    found = R.team_productivity(changes, "DAYS", 4.0).orderBy("ts").collect()
    assert [(row["authors"], row["totalExperience"], row["experienceFactor"]) for row in found] == [
        (1, 0.25, 0.25),
        (1, 0.5, 0.5),
        (2, 1.0, 0.5),
        (1, 1.25, 1.25),
    ]


def test_only_unknown_authors_give_no_factor(spark):
    row = R.team_productivity(statuses(spark, ("1", 1, "Doing", None)), "DAYS", 4.0).first()
    assert (row["authors"], row["totalExperience"], row["experienceFactor"]) == (0, 0.25, None)


def test_count_by_state(spark, rows):
    changes = statuses(spark, ("1", 6, "todo", None), ("1", 15, "done", None), ("2", 14, "todo", None))
    weeks = [datetime(2020, 1, day) for day in (6, 13, 20)]
    # Both ends count: item 1 is still "todo" in the week it is done, and all last until the 20th.
    assert rows(R.count_by_state(changes, "WEEKS", AS_OF), "week", "statusName", "count") == sorted(
        [(weeks[0], "todo", 1), (weeks[1], "todo", 2), (weeks[2], "todo", 1), (weeks[1], "done", 1), (weeks[2], "done", 1)],
        key=repr,
    )


def test_a_state_entered_twice_counts_twice(spark, rows):
    changes = statuses(spark, ("1", 6, "todo", None), ("1", 7, "doing", None), ("1", 8, "todo", None))
    counts = R.count_by_state(changes, "WEEKS", "2020-01-09")
    assert rows(counts, "statusName", "count") == [("doing", 1), ("todo", 2)]


def test_changes_after_the_report_time_are_no_stay(spark, rows):
    changes = statuses(spark, ("1", 6, "todo", None), ("1", 9, "done", None))
    assert rows(R.count_by_state(changes, "DAYS", "2020-01-07"), "statusName") == [("todo",)] * 4


@pytest.mark.parametrize("minutes", [1, 60, 10**6])
@pytest.mark.parametrize("unit", ["DAYS", "WEEKS"])
def test_summed_steps_equal_listed_periods(spark, rows, unit, minutes):
    states = ["todo", "doing", "done"]
    changes = statuses(spark, *[(str(n % 5), 1 + (n * 7) % 27, states[n % 3], None) for n in range(60)])
    spans = R.state_spans(changes, AS_OF, span_minutes=minutes)
    periods = date_range(unit, period_date(unit, "start"), period_date(unit, "end"))
    listed = (
        spans.select("statusName", F.explode(periods.cast("array<timestamp_ntz>")).alias("week"))
        .groupBy("week", "statusName")
        .count()
    )
    assert rows(R.count_by_state(changes, unit, AS_OF), "week", "statusName", "count") == rows(listed)


def test_moving_average_has_one_row_more_than_asked(spark):
    first = datetime(2020, 1, 1, 9)
    data = [(str(n), first + timedelta(days=min(n, 3)), "todo", n) for n in range(4)]
    changes = spark.createDataFrame(data, "id string, statusCreated timestamp_ntz, statusName string, pos long")
    found = R.count_by_state_moving_average(changes, 1, "DAYS", "2020-01-04").orderBy("week").collect()
    # Counts are 1, 2, 3, 4; each mean is over the day and the one before.
    assert [row["moving_average"] for row in found] == [1.0, 1.5, 2.5, 3.5]


def test_nested_items_give_the_same_stays(spark, rows):
    states = ["todo", "doing", "done"]
    changes = statuses(spark, *[(str(n % 5), 1 + (n * 7) % 27, states[n % 3], None) for n in range(60)])
    nested = changes.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("statusCreated").alias("created"), F.col("statusName").alias("name")))).alias(
            "statusHistory"
        )
    )
    assert rows(R.nested_state_spans(nested, AS_OF)) == rows(R.state_spans(changes, AS_OF))
    assert rows(R.count_by_state(nested, "WEEKS", AS_OF), "week", "statusName", "count") == rows(
        R.count_by_state(changes, "WEEKS", AS_OF), "week", "statusName", "count"
    )


def test_authors_of_longer_periods_from_sketches(spark):
    weeks = [F.lit(f"2024-01-{day:02d} 10:00:00").cast("timestamp_ntz") for day in (4, 9, 16, 23)]
    rows = spark.range(80_000).select(
        F.array(*weeks)[(F.col("id") % 4).cast("int")].alias("statusCreated"),
        F.concat(F.lit("a"), (F.col("id") % 29_989).cast("string")).alias("statusAuthor"),
        F.lit("doing").alias("statusName"),
    )
    weekly = R.count_distinct_authors(rows, "WEEKS", (), sketch_bits=12).withColumnRenamed("ts", "time")
    merged = {r["time"].date().isoformat(): r["count"] for r in rebucket_distinct(weekly, "4 weeks").collect()}
    exact = {"2023-12-21": set(), "2024-01-18": set()}
    for at in range(80_000):
        exact["2023-12-21" if at % 4 < 3 else "2024-01-18"].add(at % 29_989)
    assert set(merged) == set(exact)
    for start, values in exact.items():
        assert abs(merged[start] / len(values) - 1) < 3 * 1.04 / 64
    assert "sketch" not in R.count_distinct_authors(rows, "WEEKS").columns
