"""Reading stored metrics: filters, time ranges, series, re-bucketing, tag values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.time import as_time

ALL = "all"

_OPERATORS = {
    "=": lambda column, value: column == value,
    "!=": lambda column, value: column != value,
    "<>": lambda column, value: column != value,
    "<": lambda column, value: column < value,
    ">": lambda column, value: column > value,
    "=~": lambda column, value: column.rlike(value),
    "!~": lambda column, value: ~column.rlike(value),
}


def _tag(name: str) -> Column:
    return F.col(f"`{name}`")


def tags_equal(points: DataFrame, **tags: str) -> DataFrame:
    for name, value in tags.items():
        points = points.where(_tag(name) == value)
    return points


def tag_matches(points: DataFrame, tag: str, pattern: str) -> DataFrame:
    """Keep points whose whole tag matches ``pattern``; ``all`` keeps every point."""
    if pattern == ALL:
        return points
    return points.where(_tag(tag).rlike(f"^({pattern})$"))


def where_all(points: DataFrame, conditions: Iterable[tuple[str, str, object]]) -> DataFrame:
    """Free filters as (column, operator, value); operators ``= != <> < > =~ !~``."""
    for name, operator, value in conditions:
        if operator not in _OPERATORS:
            raise ValueError(f"unknown operator {operator!r}")
        points = points.where(_OPERATORS[operator](_tag(name), value))
    return points


def since(points: DataFrame, as_of, months: int = 0, days: int = 0) -> DataFrame:
    """Points of the last months and days up to ``as_of``."""
    end = as_time(as_of)
    start = end - F.make_ym_interval(F.lit(0), F.lit(months)) - F.make_dt_interval(F.lit(days))
    return points.where(F.col("time").between(start, end))


def series(points: DataFrame, fields: Sequence[str], tags: Sequence[str] = ()) -> DataFrame:
    """Time, the tags that name a series, and the fields."""
    return points.select("time", *[_tag(name) for name in (*tags, *fields)])


def one_column_per_value(points: DataFrame, field: str, tag: str, values: Sequence[str]) -> DataFrame:
    """One column per listed tag value, summed over the other tags."""
    return points.groupBy("time").pivot(tag, list(values)).agg(F.sum(_tag(field)))


def rebucket(points: DataFrame, field: str, width: str, tags: Sequence[str] = (), name: str = "sum") -> DataFrame:
    """Sum a field over windows of ``width`` (such as ``4 weeks``); empty windows give no row.

    Windows are counted from 1970-01-01.
    """
    return (
        points.groupBy(F.window("time", width).alias("_window"), *[_tag(tag) for tag in tags])
        .agg(F.sum(_tag(field)).alias(name))
        .select(F.col("_window.start").alias("time"), *[_tag(tag) for tag in tags], name)
    )


def rebucket_distinct(
    points: DataFrame, width: str, tags: Sequence[str] = (), sketch: str = "sketch", name: str = "count"
) -> DataFrame:
    """Distinct values over windows of ``width``, from the sketches of the points in them.

    Adding up distinct counts would count a value once per point. The points must come from one report, so that all
    sketches are of the same kind of value. Windows are those of :func:`rebucket`.
    """
    return (
        points.groupBy(F.window("time", width).alias("_window"), *[_tag(tag) for tag in tags])
        .agg(F.hll_sketch_estimate(F.hll_union_agg(_tag(sketch), F.lit(True))).alias(name))
        .select(F.col("_window.start").alias("time"), *[_tag(tag) for tag in tags], name)
    )


def tag_values(points: DataFrame, tag: str) -> DataFrame:
    return points.select(_tag(tag)).distinct().orderBy(_tag(tag))


def newest_first(points: DataFrame, fields: Sequence[str]) -> DataFrame:
    return points.select("time", *[_tag(name) for name in fields]).orderBy(F.col("time").desc())


def null_as_zero(points: DataFrame, fields: Sequence[str]) -> DataFrame:
    return points.withColumns({name: F.coalesce(_tag(name), F.lit(0)) for name in fields})


def matching(points: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Several pattern filters at once."""
    for tag, pattern in patterns.items():
        points = tag_matches(points, tag, pattern)
    return points
