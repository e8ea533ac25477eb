"""Reports on issues: change log, counts, authors, team experience, queue sizes.

Status-based reports take flat status rows (see ``work_items.flatten``);
``series`` names columns, such as the project, that keep series apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions.names import experience_factor
from flowgauge.functions.distinct import distinct_sketch
from flowgauge.functions.time import as_time, date_range, period_date, period_start, shift_period, time_span
from flowgauge.operators.work_items import by_history, truncate_times

# Histories are cut into spans of this length.
SPAN_MINUTES = 1

# States in which nobody works on an item.
IDLE_STATES = ("Backlog", "Upcoming", "Done")

CHANGE_LOG_KEYS = ("time", "id", "type", "priority", "changedBy", "status", "epic")


def in_development(statuses: DataFrame, idle_states: Sequence[str] = IDLE_STATES) -> DataFrame:
    return statuses.where(~F.col("statusName").isin(list(idle_states)))


def change_log(statuses: DataFrame, unit: str, series: Sequence[str] = ()) -> DataFrame:
    """One row per item, state, author and period; repeated changes fall together."""
    bucketed = truncate_times(statuses, unit)
    return (
        bucketed.select(
            *series,
            F.col("statusCreated").alias("time"),
            "id",
            "type",
            "priority",
            F.coalesce("statusAuthor", F.lit("")).alias("changedBy"),
            F.col("statusName").alias("status"),
            F.coalesce("epicName", F.lit("No epic")).alias("epic"),
        )
        .distinct()
        .withColumn("count", F.lit(1))
    )


def count_by_type_priority(items: DataFrame, unit: str, series: Sequence[str] = ()) -> DataFrame:
    """Items created per period, type and priority; one input row per item."""
    return items.groupBy(*series, "type", "priority", period_start(unit, "created").alias("ts")).count()


def count_distinct_authors(
    statuses: DataFrame,
    unit: str,
    idle_states: Sequence[str] = IDLE_STATES,
    series: Sequence[str] = (),
    relative_error: float | None = None,
    sketch_bits: int | None = None,
) -> DataFrame:
    """Authors of status changes per period; approximate if an error is allowed.

    With ``sketch_bits`` (4 to 21) a column ``sketch`` is added, from which
    ``metric_queries.rebucket_distinct`` counts the authors of longer periods.
    """
    authors = (
        F.count_distinct("statusAuthor")
        if relative_error is None
        else F.approx_count_distinct("statusAuthor", relative_error)
    )
    return (
        in_development(statuses, idle_states)
        .groupBy(*series, period_start(unit, "statusCreated").alias("ts"))
        .agg(authors.alias("authors"), *distinct_sketch("statusAuthor", sketch_bits))
    )


def team_productivity(
    statuses: DataFrame,
    unit: str,
    learning_time: float,
    idle_states: Sequence[str] = IDLE_STATES,
    series: Sequence[str] = (),
) -> DataFrame:
    """Experience of the team per period.

    An author is present from the first to the last period in which an item they
    worked on was created, and gains ``1/learning_time`` per period up to 1.
    Authors of equal presence are counted together before the periods are listed,
    so the listing grows with the calendar and not with the number of authors.
    """
    created = period_date(unit, "created")
    presence = (
        in_development(statuses, idle_states)
        .groupBy(*series, "statusAuthor")
        .agg(F.min(created).alias("first"), F.max(created).alias("last"))
        .groupBy(*series, "first", "last")
        # An unknown author adds experience but is not counted as an author.
        .agg(F.count("statusAuthor").alias("authors"), F.count(F.lit(1)).alias("people"))
    )
    listed = presence.select(
        *series, "authors", "people", F.posexplode(date_range(unit, "first", "last")).alias("periods_before", "period")
    )
    experience = F.col("people") * experience_factor(F.col("periods_before") + 1, learning_time)
    return (
        listed.groupBy(*series, F.col("period").cast("timestamp_ntz").alias("ts"))
        .agg(F.sum("authors").alias("authors"), F.sum(experience).alias("totalExperience"))
        .withColumn("experienceFactor", F.try_divide("totalExperience", "authors"))
    )


def state_spans(
    statuses: DataFrame,
    as_of,
    keys: Sequence[str] = ("id",),
    span_minutes: int = SPAN_MINUTES,
) -> DataFrame:
    """When each status of an item began and ended; the last one lasts until ``as_of``.

    Within a span of time the next row ends a status; the last row of a span is
    ended by the first row of the item's next span. Only these last rows meet in one
    group per item, so an item with very many changes is spread over many tasks.
    """
    rows = statuses.select(*keys, "statusName", "pos", F.col("statusCreated").alias("start"))
    in_span = Window.partitionBy(*keys, "span").orderBy("start", "pos")
    paired = rows.withColumn("span", time_span("start", span_minutes)).withColumns(
        {
            "end": F.lead("start").over(in_span),
            "span_start": F.first("start").over(in_span.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    closed = paired.where(F.col("end").isNotNull()).select(*keys, "statusName", "start", "end")
    next_start = F.lead("span_start").over(Window.partitionBy(*keys).orderBy("span"))
    last_of_span = paired.where(F.col("end").isNull()).select(
        *keys, "statusName", "start", F.coalesce(next_start, as_time(as_of)).alias("end")
    )
    return closed.unionByName(last_of_span)


def nested_state_spans(items: DataFrame, as_of, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The same for nested items, within the row: nothing is shuffled."""
    ordered = F.array_sort(
        F.transform("statusHistory", lambda status, at: F.struct(status["created"], at, status["name"].alias("name")))
    )
    spans = F.transform(
        "_ordered",
        lambda status, at: F.struct(
            status["name"].alias("statusName"),
            status["created"].alias("start"),
            F.coalesce(F.get("_ordered", at + 1)["created"], as_time(as_of)).alias("end"),
        ),
    )
    return items.select(*keys, ordered.alias("_ordered")).select(*keys, F.inline(spans))


def count_by_state(statuses: DataFrame, unit: str, as_of, series: Sequence[str] = ()) -> DataFrame:
    """Items per state and period; the first and last period of a stay both count.

    An item that enters a state several times in a period counts each time. Stays
    are turned into +1 and -1 at their ends and summed over time, so the work does
    not grow with their length. Takes flat status rows or nested items.
    """
    alone, together = by_history(statuses)
    parts = [find(rows, as_of, (*series, "id")) for find, rows in ((nested_state_spans, alone), (state_spans, together)) if rows is not None]
    spans = reduce(DataFrame.unionByName, parts)
    first, last = period_date(unit, "start"), period_date(unit, "end")
    ends = F.array(
        F.struct(first.alias("period"), F.lit(1).cast("long").alias("step")),
        F.struct(shift_period(unit, last, 1).alias("period"), F.lit(-1).cast("long").alias("step")),
    )
    steps = (
        spans.where(last >= first)
        .select(*series, "statusName", F.inline(ends).alias("period", "step"))
        .groupBy(*series, "statusName", "period")
        .agg(F.sum("step").alias("step"))
    )
    by_time = Window.partitionBy(*series, "statusName").orderBy("period")
    levels = steps.withColumns(
        {
            "count": F.sum("step").over(by_time.rowsBetween(Window.unboundedPreceding, 0)),
            "following": F.lead("period").over(by_time),
        }
    ).where((F.col("count") > 0) & F.col("following").isNotNull())
    until = shift_period(unit, "following", -1)
    return levels.select(
        *series, F.explode(date_range(unit, "period", until)).alias("week"), "statusName", "count"
    ).withColumn("week", F.col("week").cast("timestamp_ntz"))


def count_by_state_moving_average(
    statuses: DataFrame, duration: int, unit: str, as_of, series: Sequence[str] = ()
) -> DataFrame:
    """Mean over the row and up to ``duration`` rows before it; periods without items are not rows."""
    recent = Window.partitionBy(*series, "statusName").orderBy("week").rowsBetween(-duration, 0)
    return count_by_state(statuses, unit, as_of, series).select(
        *series, "week", "statusName", F.avg("count").over(recent).alias("moving_average")
    )
