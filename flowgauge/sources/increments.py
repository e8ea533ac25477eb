"""Which part of the landed data to load next."""

from __future__ import annotations

from calendar import monthrange
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.time import as_time

# Months per load, and years to go back when nothing is stored yet.
LOAD_MONTHS = 12
FIRST_LOAD_YEARS = 10

Window = tuple[datetime, datetime]


def high_water_mark(stored: DataFrame) -> DataFrame:
    """One row with the last stored time, null if there is none; reads one column."""
    return stored.agg(F.max("time").alias("last"))


def load_window(
    stored: DataFrame | None, as_of, months_back: int = 0, months_ahead: int = LOAD_MONTHS
) -> Window:
    """Start and end of the next load.

    It begins ``months_back`` before the last stored time, or ten years before
    ``as_of`` at first. What is loaded twice replaces itself in the metric store.
    ``stored`` may be cut down to the last stored month.
    """
    last = None if stored is None else high_water_mark(stored).first()["last"]
    if last is None:
        start = _shifted(as_of, -12 * FIRST_LOAD_YEARS)
    else:
        start = _shifted(last, -months_back)
    return start, _shifted(start, months_back + months_ahead)


def _shifted(moment, months: int) -> datetime:
    """The same day and time some months away, or the last day of that month if it is shorter."""
    moment = moment if isinstance(moment, datetime) else datetime.fromisoformat(str(moment))
    year, month = divmod(moment.year * 12 + moment.month - 1 + months, 12)
    return moment.replace(year=year, month=month + 1, day=min(moment.day, monthrange(year, month + 1)[1]))


def commit_window(stored: DataFrame | None, as_of) -> Window:
    """A year from the last stored commit on."""
    return load_window(stored, as_of)


def merge_request_window(stored: DataFrame | None, as_of) -> Window:
    """From a year before the last stored merge request to a year after it: states change."""
    return load_window(stored, as_of, months_back=LOAD_MONTHS)


def within(points: DataFrame, window: Window) -> DataFrame:
    start, end = window
    return points.where(F.col("time").between(as_time(start), as_time(end)))
