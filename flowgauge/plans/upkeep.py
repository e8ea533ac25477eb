"""Keeping stored reports up to date: only periods that new loads touch are computed again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import DataFrame

from flowgauge.functions.time import WEEKS, check_unit
from flowgauge.plans.ingest import load_commits
from flowgauge.plans.reports import LIFE_SPANS, ON_COMMITS, Options, Tables, run_reports
from flowgauge.sinks.metric_store import MetricStore

DAY = timedelta(days=1)


def touched_months(store: MetricStore, measurement: str, after_load: int) -> list[str]:
    """Months in which loads above a number have written points; read from the manifest alone."""
    entries = store.entries(measurement)
    return sorted({entry.month for entry in entries if entry.load_id is None or entry.load_id > after_load})


def touched_windows(months: Sequence[str], unit: str) -> list[tuple[date, date]]:
    """First and last days of the whole periods that reach into the months; neighbours are joined."""
    check_unit(unit)
    windows: list[tuple[date, date]] = []
    for month in sorted(months):
        first = date.fromisoformat(f"{month}-01")
        last = (first + 31 * DAY).replace(day=1) - DAY
        if unit == WEEKS:
            first, last = first - first.weekday() * DAY, last + (6 - last.weekday()) * DAY
        if windows and first <= windows[-1][1] + DAY:
            windows[-1] = windows[-1][0], last
        else:
            windows.append((first, last))
    return windows


def touched_commits(store: MetricStore, after_load: int, unit: str) -> DataFrame | None:
    """All commits of the periods that loads above a number touch; None if there are none.

    Only month folders of these periods are opened, so the rows read follow the load, not the store.
    """
    windows = touched_windows(touched_months(store, "commits", after_load), unit)
    parts = [load_commits(store, first, datetime.combine(last, time.max)) for first, last in windows]
    return reduce(DataFrame.unionByName, parts) if parts else None


def refresh_commit_reports(
    source: MetricStore,
    target: MetricStore,
    load_id: int,
    after_load: int,
    run: Sequence[tuple[str, str]],
    tables: Tables,
    options: Options,
) -> None:
    """Bring stored commit reports up to date with the loads of commits above ``after_load``, as one load of points.

    Every report but the life spans belongs to one period, so touched periods are computed again from all of
    their commits and the rest stays as stored. A life span reaches over all periods, and a rank cut to the first
    ``top_k`` leaves points behind that are no longer among them: both need a full run, and are an error here.
    """
    unfit = [name for name, _ in run if name not in ON_COMMITS or name in LIFE_SPANS]
    if unfit or options.top_k is not None:
        raise ValueError(f"these need a full run: {unfit or 'ranks with top_k'}")
    for unit in dict.fromkeys(unit for _, unit in run):
        commits = touched_commits(source, after_load, unit)
        if commits is not None:
            run_reports(target, load_id, [pair for pair in run if pair[1] == unit], replace(tables, commits=commits), options)
