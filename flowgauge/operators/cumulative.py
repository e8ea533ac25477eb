"""Cumulative flow: arrivals, departures, work in progress, cycle time, throughput.

All windows run over rows that are already aggregated to one per series and
period. A series (project, qualifier, …) is named by the ``series`` columns;
any number of them is computed in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions.time import (
    complete_units,
    date_range,
    days_between,
    period_date,
    period_start,
    shift_period,
)
from flowgauge.operators.flow import normalize_items, normalize_statuses
from flowgauge.operators.work_items import by_history
from flowgauge.settings import FlowReport, FlowSpec

COUNT = "count"
ESTIMATE = "estimate"

# Estimates are added up with six decimal places.
_EXACT = "decimal(30,6)"
_MEASURES = ("entry_change", "final_change", "entry_total", "final_total", "wip_current")


def select_items(
    items: DataFrame,
    types: Sequence[str] | None = None,
    priorities: Sequence[str] | None = None,
    created_after=None,
) -> DataFrame:
    """Items of the given types and priorities, created after the start of a day."""
    if types is not None:
        items = items.where(F.col("type").isin(list(types)))
    if priorities is not None:
        items = items.where(F.col("priority").isin(list(priorities)))
    if created_after is not None:
        items = items.where(F.col("created") > F.lit(str(created_after)).cast("timestamp_ntz"))
    return items


def period_changes(normalized: DataFrame, unit: str, aggregate: str = COUNT, series: Sequence[str] = ()) -> DataFrame:
    """Arrivals and departures per period that has any: ``entry_change``, ``final_change``.

    Two conditional sums do the work of a pivot on two known states. Estimates are
    summed as decimals, so that sums are exact and do not depend on the order.
    """
    if aggregate not in (COUNT, ESTIMATE):
        raise ValueError(f"aggregate must be {COUNT!r} or {ESTIMATE!r}, got {aggregate!r}")
    weight = F.lit(1).cast("long") if aggregate == COUNT else F.col("estimate").cast(_EXACT)
    kind = "long" if aggregate == COUNT else _EXACT
    steps = F.array(
        F.struct(F.col("entry_at").alias("at"), F.lit(False).alias("is_final")),
        F.struct(F.col("final_at").alias("at"), F.lit(True).alias("is_final")),
    )
    none = F.lit(0).cast("long" if aggregate == COUNT else _EXACT)
    return (
        normalized.select(*series, weight.alias("weight"), F.inline(steps).alias("at", "is_final"))
        .where(F.col("at").isNotNull())
        .groupBy(*series, period_date(unit, "at").alias("period"))
        .agg(
            F.coalesce(F.sum(F.when(~F.col("is_final"), F.col("weight"))), none).cast(kind).alias("entry_change"),
            F.coalesce(F.sum(F.when(F.col("is_final"), F.col("weight"))), none).cast(kind).alias("final_change"),
        )
    )


def fill_periods(changes: DataFrame, unit: str, values: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Add the missing periods between the first and last of each series, with zeros.

    Every row brings the empty periods up to the next row, so no second table is
    built and joined.
    """
    following = F.lead("period").over(Window.partitionBy(*series).orderBy("period"))
    until = F.coalesce(shift_period(unit, "following", -1), F.col("period"))
    filled = changes.withColumn("following", following).select(
        *series, *values, F.posexplode(date_range(unit, "period", until)).alias("gap", "period")
    )
    return filled.select(
        *series,
        "period",
        *[F.when(F.col("gap") == 0, F.col(name)).otherwise(F.lit(0).cast(filled.schema[name].dataType)).alias(name) for name in values],
    )


def cumulative_flow(normalized: DataFrame, unit: str, aggregate: str = COUNT, series: Sequence[str] = ()) -> DataFrame:
    """The flow table of every series, with state-independent column names.

    ``time, entry_change, final_change, entry_total, final_total, wip_current, ct,
    done_lagged, wip, th``. Cycle time is the number of whole units since the last
    period by which as many items had entered as have left by now, plus one; 0 if
    there is none. ``th`` is null where ``ct`` is 0.
    """
    filled = fill_periods(
        period_changes(normalized, unit, aggregate, series), unit, ("entry_change", "final_change"), series
    )
    running = Window.partitionBy(*series).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    totals = filled.withColumns(
        {
            "entry_total": F.sum("entry_change").over(running),
            "final_total": F.sum("final_change").over(running),
        }
    )
    table = _with_cycle_time(totals, unit, series)
    if aggregate == COUNT:
        return table
    return table.withColumns({name: F.col(name).cast("double") for name in _MEASURES})


def _with_cycle_time(totals: DataFrame, unit: str, series: Sequence[str]) -> DataFrame:
    """As-of lookup by value: greatest entry total not above the final total.

    Each row becomes an offer (keyed by its entry total) and a question (keyed by
    its final total). Sorted by key, offers before questions of the same key, the
    answer is the last offer passed: of equal totals, that of the latest period.
    """
    roles = F.array(
        F.struct(F.lit(False).alias("asks"), F.col("entry_total").alias("key")),
        F.struct(F.lit(True).alias("asks"), F.col("final_total").alias("key")),
    )
    by_value = (
        Window.partitionBy(*series).orderBy("key", "asks", "period").rowsBetween(Window.unboundedPreceding, 0)
    )
    offer = F.when(~F.col("asks"), F.struct(F.col("period").alias("at"), F.col("final_total").alias("done")))
    found = (
        totals.select("*", F.inline(roles).alias("asks", "key"))
        .withColumn("found", F.last(offer, ignorenulls=True).over(by_value))
        .where("asks")
    )
    settled = F.col("entry_total") == F.col("final_total")
    cycle = (
        F.when(settled, F.lit(1))
        .when(F.col("found").isNull(), F.lit(0))
        .otherwise(complete_units(unit, "found.at", "period") + 1)
        .cast("long")
    )
    wip = F.when(F.col("ct") == 1, F.col("final_change")).otherwise(F.col("final_total") - F.coalesce("found.done", F.lit(0)))
    return (
        found.withColumns({"ct": cycle, "done_lagged": F.coalesce(F.col("found.done").cast("double"), F.lit(0.0))})
        .withColumn("wip", wip.cast("double"))
        .select(
            *series,
            F.col("period").cast("timestamp_ntz").alias("time"),
            "entry_change",
            "final_change",
            "entry_total",
            "final_total",
            (F.col("entry_total") - F.col("final_total")).alias("wip_current"),
            "ct",
            "done_lagged",
            "wip",
            F.try_divide("wip", "ct").alias("th"),
        )
    )


def change_column(state: str) -> str:
    return f"{state} change"


def report_columns(spec: FlowSpec) -> dict[str, str]:
    """Column names of the one-series report, by our state-independent names."""
    return {
        "time": "Time",
        "entry_change": change_column(spec.entry_state),
        "final_change": change_column(spec.final_state),
        "entry_total": spec.entry_state,
        "final_total": spec.final_state,
        "wip_current": "WIP current",
        "ct": "CT",
        "done_lagged": "doneLaggedByCT",
        "wip": "WIP",
        "th": "TH",
    }


def with_report_columns(flow: DataFrame, spec: FlowSpec) -> DataFrame:
    return flow.withColumnsRenamed(report_columns(spec))


def averages(flow: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Mean throughput, cycle time and current work in progress; nulls are left out."""
    return flow.groupBy(*series).agg(
        F.avg("th").alias("avg_th"), F.avg("ct").alias("avg_ct"), F.avg("wip_current").alias("avg_wip_current")
    )


def item_durations(normalized: DataFrame, unit: str, series: Sequence[str] = ()) -> DataFrame:
    """Days from entry to final state, both counted, by period of entry.

    Unfinished items count as one day.
    """
    days = days_between("entry_at", F.coalesce("final_at", "entry_at")) + 1
    return (
        normalized.groupBy(*series, period_start(unit, "entry_at").alias("created"))
        .agg(F.avg(days).alias("mean"), F.min(days).alias("min"), F.max(days).alias("max"))
    )


def normalize(
    items: DataFrame, spec: FlowSpec | Mapping[str, FlowSpec], keys: Sequence[str], attributes: Sequence[str]
) -> DataFrame:
    """Normalize nested items in place, or flat status rows by group."""
    alone, together = by_history(items)
    parts = []
    if alone is not None:
        parts.append(normalize_items(alone, spec).select(*keys, *attributes, "entry_at", "final_at"))
    if together is not None:
        parts.append(normalize_statuses(together, spec, keys, attributes))
    return reduce(DataFrame.unionByName, parts)


def flow_table(
    items: DataFrame,
    spec: FlowSpec | Mapping[str, FlowSpec],
    unit: str,
    aggregate: str = COUNT,
    types: Sequence[str] | None = None,
    priorities: Sequence[str] | None = None,
    created_after=None,
    series: Sequence[str] = (),
) -> DataFrame:
    """Filter, normalize and tabulate nested items or flat status rows."""
    chosen = select_items(items, types, priorities, created_after)
    attributes = ("estimate",) if aggregate == ESTIMATE else ()
    normalized = normalize(chosen, spec, (*series, "id"), attributes)
    return cumulative_flow(normalized, unit, aggregate, series)


def duration_table(
    items: DataFrame,
    spec: FlowSpec | Mapping[str, FlowSpec],
    unit: str,
    types: Sequence[str] | None = None,
    priorities: Sequence[str] | None = None,
    created_after=None,
    series: Sequence[str] = (),
) -> DataFrame:
    chosen = select_items(items, types, priorities, created_after)
    return item_durations(normalize(chosen, spec, (*series, "id"), ()), unit, series)


def specs_between(
    spec: FlowSpec | Mapping[str, FlowSpec], entry_state: str | None, final_state: str | None
) -> FlowSpec | Mapping[str, FlowSpec]:
    """The spec, or all specs, with other measured states where they are given."""
    if isinstance(spec, FlowSpec):
        return spec.between(entry_state, final_state)
    return {project: own.between(entry_state, final_state) for project, own in spec.items()}


def _matches(report: FlowReport) -> Column:
    fits = F.lit(True)
    if report.types is not None:
        fits = fits & F.col("type").isin(list(report.types))
    if report.priorities is not None:
        fits = fits & F.col("priority").isin(list(report.priorities))
    return fits


def normalized_reports(
    items: DataFrame,
    spec: FlowSpec | Mapping[str, FlowSpec],
    reports: Sequence[FlowReport],
    attributes: Sequence[str] = (),
    series: Sequence[str] = (),
) -> list[tuple[DataFrame, list[FlowReport]]]:
    """Normalized items for each pair of entry and final state, and the reports that are made of them.

    There may be one spec per project; a report without states takes those of each.
    """
    by_states: dict[tuple[str | None, str | None], list[FlowReport]] = {}
    for report in reports:
        states = (report.entry_state, report.final_state)
        if isinstance(spec, FlowSpec):
            states = (states[0] or spec.entry_state, states[1] or spec.final_state)
        by_states.setdefault(states, []).append(report)
    found = []
    for states, wanted in by_states.items():
        anyone = reduce(lambda some, more: some | more, [_matches(report) for report in wanted])
        keys, kept = (*series, "id"), ("type", "priority", *attributes)
        found.append((normalize(items.where(anyone), specs_between(spec, *states), keys, kept), wanted))
    return found


def report_tables(
    normalized: Sequence[tuple[DataFrame, Sequence[FlowReport]]], aggregate: str = COUNT, series: Sequence[str] = ()
) -> DataFrame:
    """Flow tables of all reports on normalized items; reports of one bucket size share all steps."""
    tables = []
    for items, reports in normalized:
        by_unit: dict[str, list[FlowReport]] = {}
        for report in reports:
            by_unit.setdefault(report.unit, []).append(report)
        for unit, wanted in by_unit.items():
            names = F.array_compact(F.array(*[F.when(_matches(report), F.lit(report.qualifier)) for report in wanted]))
            spread = items.select("*", F.explode(names).alias("qualifier"))
            table = cumulative_flow(spread, unit, aggregate, (*series, "qualifier"))
            tables.append(table.withColumn("interval", F.lit(unit)))
    return reduce(DataFrame.unionByName, tables)


def flow_tables(
    items: DataFrame,
    spec: FlowSpec | Mapping[str, FlowSpec],
    reports: Sequence[FlowReport],
    aggregate: str = COUNT,
    series: Sequence[str] = (),
) -> DataFrame:
    """Many qualified reports in one job: ``series + qualifier, interval`` and the flow columns.

    Items are normalized once per pair of entry and final state and then handed to
    every report that wants them; those of one bucket size share all later steps.
    """
    attributes = ("estimate",) if aggregate == ESTIMATE else ()
    return report_tables(normalized_reports(items, spec, reports, attributes, series), aggregate, series)
