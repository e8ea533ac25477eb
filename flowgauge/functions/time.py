"""Calendar arithmetic on wall-clock time.

Everything works on ``timestamp_ntz`` and ``date`` values, so results depend
neither on the session zone nor on daylight saving.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = "DAYS"
WEEKS = "WEEKS"
MONTHS = "MONTHS"
UNITS = (DAYS, WEEKS, MONTHS)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def check_unit(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"interval must be one of {UNITS}, got {unit!r}")
    return unit


def period_date(unit: str, ts: Column | str) -> Column:
    """First day of the day, ISO week or month that holds ``ts``, as a date."""
    day = as_column(ts).cast("date")
    if check_unit(unit) == DAYS:
        return day
    return F.trunc(day, "week" if unit == WEEKS else "month")


def period_start(unit: str, ts: Column | str) -> Column:
    """:func:`period_date` as ``timestamp_ntz``."""
    return period_date(unit, ts).cast("timestamp_ntz")


def shift_period(unit: str, day: Column | str, count: int) -> Column:
    """The date ``count`` whole periods after ``day``."""
    day = as_column(day)
    if check_unit(unit) == MONTHS:
        return F.add_months(day, count)
    return F.date_add(day, count * (7 if unit == WEEKS else 1))


def time_span(ts: Column | str, minutes: int) -> Column:
    """Number of the span of ``minutes`` that holds ``ts``, counted from 1970."""
    ts = as_column(ts)
    day = F.datediff(ts.cast("date"), _epoch().cast("date")).cast("long")
    return F.floor((day * 1440 + F.hour(ts) * 60 + F.minute(ts)) / minutes)


def period_step(unit: str) -> Column:
    return F.expr({DAYS: "INTERVAL 1 DAY", WEEKS: "INTERVAL 7 DAY", MONTHS: "INTERVAL 1 MONTH"}[check_unit(unit)])


def days_between(start: Column | str, end: Column | str) -> Column:
    """Calendar days between two dates or timestamps, time of day ignored."""
    return F.datediff(as_column(end).cast("date"), as_column(start).cast("date")).cast("long")


def _complete_months(start: Column, end: Column) -> Column:
    def into_month(ts: Column) -> Column:
        return ts - F.trunc(ts.cast("date"), "month").cast("timestamp_ntz")

    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    unfinished = F.when((months > 0) & (into_month(end) < into_month(start)), -1).when(
        (months < 0) & (into_month(end) > into_month(start)), 1
    )
    return (months + F.coalesce(unfinished, F.lit(0))).cast("long")


def complete_units(unit: str, start: Column | str, end: Column | str) -> Column:
    """Whole days, weeks or months between two *dates* (time of day ignored)."""
    start, end = as_column(start).cast("date"), as_column(end).cast("date")
    if check_unit(unit) == MONTHS:
        return _complete_months(start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))
    days = F.datediff(end, start)
    return (days / (7 if unit == WEEKS else 1)).cast("long")


def complete_units_of_time(unit: str, start: Column | str, end: Column | str) -> Column:
    """Whole days, weeks or months between two *timestamps*, time of day counted."""
    start, end = as_column(start).cast("timestamp_ntz"), as_column(end).cast("timestamp_ntz")
    if check_unit(unit) == MONTHS:
        return _complete_months(start, end)
    days = F.extract(F.lit("DAY"), end - start)
    return (days / (7 if unit == WEEKS else 1)).cast("long")


def weeks_between(start: Column | str, end: Column | str) -> Column:
    return complete_units(WEEKS, start, end)


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Complete hours between two timestamps."""
    gap = as_column(end).cast("timestamp_ntz") - as_column(start).cast("timestamp_ntz")
    return (F.extract(F.lit("DAY"), gap) * 24 + F.extract(F.lit("HOUR"), gap)).cast("long")


def date_range(unit: str, start: Column | str, end: Column | str) -> Column:
    """Dates ``start, start+1, …`` up to the last complete unit; empty if reversed.

    Month steps are taken from ``start`` (31 Jan, 29 Feb, 31 Mar).
    """
    start, end = as_column(start).cast("date"), as_column(end).cast("date")
    dates = F.sequence(start, end, period_step(unit))
    if unit == MONTHS:
        dates = F.slice(dates, F.lit(1), complete_units(unit, start, end).cast("int") + 1)
    return F.when(end >= start, dates).otherwise(F.array().cast("array<date>"))


def weekday_name(ts: Column | str) -> Column:
    """Upper-case English day name."""
    return F.upper(F.date_format(as_column(ts).cast("date"), "EEEE"))


def iso_week_number(ts: Column | str) -> Column:
    """ISO week number; the ISO year is not part of it."""
    return F.weekofyear(as_column(ts).cast("date"))


def _without_zone_name(text: Column | str) -> Column:
    return F.substring_index(as_column(text), "[", 1)


def parse_wall_clock(text: Column | str) -> Column:
    """Local date and time of an offset timestamp, the offset dropped."""
    return _without_zone_name(text).cast("timestamp_ntz")


def parse_wall_date(text: Column | str) -> Column:
    """Local date of an offset timestamp, from the date part alone: much cheaper than parsing the time."""
    return F.substring(as_column(text), 1, 10).cast("date")


def parse_instant(text: Column | str) -> Column:
    """UTC wall clock of an offset timestamp such as ``2019-08-05T10:19:50.000+0200``."""
    return epoch_micros_to_time(F.unix_micros(_without_zone_name(text).cast("timestamp")))


def parse_epoch_millis(text: Column | str) -> Column:
    """Epoch milliseconds of an offset timestamp."""
    return F.unix_millis(_without_zone_name(text).cast("timestamp"))


PARSERS = {"wall_clock": parse_wall_clock, "instant": parse_instant}


def parse_time(text: Column | str, mode: str = "wall_clock") -> Column:
    if mode not in PARSERS:
        raise ValueError(f"time mode must be one of {tuple(PARSERS)}, got {mode!r}")
    return PARSERS[mode](text)


def parse_date(text: Column | str) -> Column:
    return F.to_date(as_column(text), "yyyy-MM-dd")


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def epoch_micros_to_time(micros: Column | str) -> Column:
    """UTC wall clock of epoch microseconds."""
    return _epoch() + F.expr("INTERVAL '0.000001' SECOND") * as_column(micros)


def epoch_millis_to_time(millis: Column | str) -> Column:
    return epoch_micros_to_time(as_column(millis).cast("long") * 1000)


def time_to_epoch_millis(ts: Column | str) -> Column:
    """Epoch milliseconds of a UTC wall clock."""
    ts = as_column(ts).cast("timestamp_ntz")
    days = F.datediff(ts.cast("date"), _epoch().cast("date")).cast("long")
    minutes = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return (minutes * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000)).cast("long")


def or_as_of(ts: Column | str, as_of) -> Column:
    """``ts``, or the explicit report time where it is missing."""
    return F.coalesce(as_column(ts), as_time(as_of))


def as_time(value) -> Column:
    """A literal or column as ``timestamp_ntz``."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")
