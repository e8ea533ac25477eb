"""Metric points: typed wide rows, and their long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_points(
    df: DataFrame,
    time: str,
    tags: Mapping[str, str] | Sequence[str],
    fields: Mapping[str, str] | Sequence[str],
    constants: Mapping[str, str] | None = None,
) -> DataFrame:
    """``time``, then constant tags, tags and fields; mappings give new names to columns."""

    def named(columns) -> list[Column]:
        pairs = columns.items() if isinstance(columns, Mapping) else [(name, name) for name in columns]
        return [F.col(f"`{source}`").alias(name) for name, source in pairs]

    fixed = [F.lit(value).alias(name) for name, value in (constants or {}).items()]
    tagged = [column.cast("string") for column in named(tags)]
    names = list(tags)
    return df.select(
        F.col(f"`{time}`").alias("time"),
        *fixed,
        *[column.alias(name) for name, column in zip(names, tagged)],
        *named(fields),
    )


def long_form(points: DataFrame, measurement: str, tags: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One shape for all measurements: tags as text and fields as doubles, in maps."""

    def as_map(names: Sequence[str], kind: str) -> Column:
        pairs = [part for name in names for part in (F.lit(name), F.col(f"`{name}`").cast(kind))]
        return F.create_map(*pairs) if pairs else F.lit(None).cast(f"map<string,{kind}>")

    return points.select(
        F.lit(measurement).alias("measurement"), "time", as_map(tags, "string").alias("tags"), as_map(fields, "double").alias("fields")
    )


def as_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, in column ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
