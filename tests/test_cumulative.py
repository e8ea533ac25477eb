from datetime import datetime

import pytest
from flowgauge.functions.time import complete_units
from flowgauge.operators import cumulative as C
from flowgauge.settings import FlowReport, FlowSpec
from pyspark.sql import functions as F

SPEC = FlowSpec({"todo": 0, "doing": 1, "done": 2}, "todo", "done")


def normalized(spark, *items):
    """Items as (project, estimate, entry day, final day) in January 2020."""

    def at(day):
        return None if day is None else datetime(2020, 1, day, 9)

    data = [(project, str(n), float(size), at(entry), at(final)) for n, (project, size, entry, final) in enumerate(items)]
    return spark.createDataFrame(
        data, "project string, id string, estimate double, entry_at timestamp_ntz, final_at timestamp_ntz"
    )


ITEMS = (("a", 1, 1, 4), ("a", 2, 1, 6), ("a", 3, 3, 6), ("a", 5, 4, None))


@pytest.mark.parametrize("start, end, expected", [("2018-05-21", "2018-05-28", 2), ("2018-05-28", "2018-08-20", 13)])
def test_cycle_time_in_weeks(spark, start, end, expected):
    days = F.lit(start).cast("date"), F.lit(end).cast("date")
    assert spark.range(1).select(complete_units("WEEKS", *days) + 1).first()[0] == expected


def test_table_by_hand(spark):
    table = C.cumulative_flow(normalized(spark, *ITEMS), "DAYS").orderBy("time").collect()
    found = [
        (
            row["time"].day, row["entry_change"], row["final_change"], row["entry_total"], row["final_total"],
            row["wip_current"], row["ct"], row["done_lagged"], row["wip"], row["th"],
        )
        for row in table
    ]
    # Nothing has left by the 3rd: no earlier day with so few arrivals, cycle time 0.
    # On the 6th three have left; as many had come by the 3rd, four days with both ends.
    assert found == [
        (1, 2, 0, 2, 0, 2, 0, 0.0, 0.0, None),
        (2, 0, 0, 2, 0, 2, 0, 0.0, 0.0, None),
        (3, 1, 0, 3, 0, 3, 0, 0.0, 0.0, None),
        (4, 1, 1, 4, 1, 3, 0, 0.0, 1.0, None),
        (5, 0, 0, 4, 1, 3, 0, 0.0, 1.0, None),
        (6, 0, 2, 4, 3, 1, 4, 0.0, 3.0, 0.75),
    ]


def test_all_done_takes_one_unit(spark):
    table = C.cumulative_flow(normalized(spark, ("a", 1, 1, 2), ("a", 1, 2, 2)), "DAYS").orderBy("time").collect()
    assert [(row["ct"], row["wip"], row["th"]) for row in table] == [(0, 0.0, None), (1, 2.0, 2.0)]


def test_equal_totals_take_the_latest_period(spark):
    # Two items had come by the 1st, and still two on the 2nd and 3rd.
    items = (("a", 1, 1, 5), ("a", 1, 1, 5), ("a", 1, 4, None))
    last = C.cumulative_flow(normalized(spark, *items), "DAYS").orderBy(F.col("time").desc()).first()
    assert (last["time"].day, last["ct"]) == (5, 3)


def test_nothing_finished(spark):
    table = C.cumulative_flow(normalized(spark, ("a", 1, 1, None), ("a", 1, 3, None)), "DAYS").collect()
    assert [row["final_total"] for row in table] == [0, 0, 0]


def test_empty_input(spark):
    table = C.cumulative_flow(normalized(spark, ("a", 1, 1, 2)).where("false"), "DAYS", series=("project",))
    assert table.collect() == [] and "ct" in table.columns


def test_estimates(spark):
    table = C.cumulative_flow(normalized(spark, *ITEMS), "DAYS", "estimate").orderBy("time").collect()
    assert [row["entry_total"] for row in table] == [3.0, 3.0, 6.0, 11.0, 11.0, 11.0]
    assert [row["final_total"] for row in table] == [0.0, 0.0, 0.0, 1.0, 1.0, 6.0]
    assert dict(C.cumulative_flow(normalized(spark, *ITEMS), "DAYS", "estimate").dtypes)["wip_current"] == "double"


def test_series_do_not_mix(spark, rows):
    other = (("b", 1, 2, 9), ("b", 1, 5, None))
    both = C.cumulative_flow(normalized(spark, *ITEMS, *other), "DAYS", series=("project",))
    for project, items in (("a", ITEMS), ("b", other)):
        alone = C.cumulative_flow(normalized(spark, *items), "DAYS")
        assert rows(both.where(F.col("project") == project).drop("project")) == rows(alone)


def test_totals_never_cross(spark):
    table = C.cumulative_flow(normalized(spark, *ITEMS), "WEEKS")
    assert table.where("final_total > entry_total OR ct < 0 OR wip_current < 0").count() == 0


def test_averages_leave_out_missing_throughput(spark):
    row = C.averages(C.cumulative_flow(normalized(spark, *ITEMS), "DAYS")).first()
    assert row["avg_th"] == 0.75 and row["avg_ct"] == pytest.approx(4 / 6)


def test_durations(spark, rows):
    found = rows(C.item_durations(normalized(spark, *ITEMS), "MONTHS"))
    assert found == [(datetime(2020, 1, 1), (4 + 6 + 4 + 1) / 4, 1, 6)]


def statuses(spark):
    data = [
        ("a", "1", "Bug", "High", datetime(2020, 1, 1, 8), 2.0, datetime(2020, 1, 1, 9), "todo", 0),
        ("a", "1", "Bug", "High", datetime(2020, 1, 1, 8), 2.0, datetime(2020, 1, 3, 9), "done", 1),
        ("a", "2", "Story", "Low", datetime(2020, 1, 2), 3.0, datetime(2020, 1, 2, 9), "todo", 0),
    ]
    return spark.createDataFrame(
        data,
        "project string, id string, type string, priority string, created timestamp_ntz, estimate double, "
        "statusCreated timestamp_ntz, statusName string, pos int",
    )


def test_item_filters(spark):
    def items(**filters):
        return C.flow_table(statuses(spark), SPEC, "MONTHS", **filters).first()["entry_total"]

    assert items() == 2
    assert items(types=("Bug",)) == 1
    assert items(priorities=("Low", "Lowest")) == 1
    # Created on the start day at midnight is not after it.
    assert items(created_after="2020-01-01") == 2
    assert C.flow_table(statuses(spark), SPEC, "MONTHS", created_after="2020-01-02").collect() == []


def test_reports_share_one_job(spark, rows):
    reports = (
        FlowReport("everything", unit="DAYS"),
        FlowReport("bugs", ("Bug",), unit="DAYS"),
        FlowReport("low", None, ("Low",), unit="MONTHS"),
        FlowReport("to doing", None, None, "todo", "doing", "DAYS"),
    )
    found = C.flow_tables(statuses(spark), SPEC, reports, series=("project",))
    for report in reports:
        spec = SPEC.between(report.entry_state, report.final_state)
        alone = C.flow_table(statuses(spark), spec, report.unit, types=report.types, priorities=report.priorities)
        of_report = found.where(F.col("qualifier") == report.qualifier)
        assert rows(of_report.drop("project", "qualifier", "interval")) == rows(alone)
        assert {row["interval"] for row in of_report.collect()} == {report.unit}


def test_report_column_names(spark):
    table = C.with_report_columns(C.flow_table(statuses(spark), SPEC, "DAYS"), SPEC)
    assert table.columns == [
        "Time", "todo change", "done change", "todo", "done", "WIP current", "CT", "doneLaggedByCT", "WIP", "TH",
    ]


def test_unknown_aggregate(spark):
    with pytest.raises(ValueError):
        C.flow_table(statuses(spark), SPEC, "DAYS", aggregate="mean")
