"""Work items from raw issues.

An issue and its whole change log are one record, so building the work item is
row-local: no shuffle, only array functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.time import parse_time, period_start
from flowgauge.operators.joins import same_keys, with_prefix
from flowgauge.schemas import ITEM_COLUMNS

STATUS_FIELD = "status"
VERSION_FIELD = "fixVersions"

# Marks nested items of which several have one id.
SHARED_ID = "_sharedId"

# Step of `pos` from one history of an issue to the next.
CHANGES_PER_HISTORY = 1 << 32


def trim_history_items(issues: DataFrame, keep: Sequence[str] = (STATUS_FIELD, VERSION_FIELD)) -> DataFrame:
    """Keep only changes of the named fields and drop histories left without any.

    Estimates and epics come from other fields: name those in ``keep`` if the
    trimmed issues are still to be turned into complete work items.
    """
    wanted = F.array(*[F.lit(name) for name in keep])

    def kept(history: Column) -> Column:
        return history.withField("items", F.filter(history["items"], lambda item: F.array_contains(wanted, item["fieldId"])))

    histories = F.filter(F.transform("changelog.histories", kept), lambda history: F.size(history["items"]) > 0)
    return issues.withColumn("changelog", F.col("changelog").withField("histories", histories))


def _changes_of(fields: Sequence[str], time_mode: str) -> Column:
    """Changes of the given fields in document order, with their time, place and author."""

    def of_history(history: Column, number: Column) -> Column:
        created = parse_time(history["created"], time_mode)
        return F.transform(
            F.filter(history["items"], lambda item: item["fieldId"].isin(list(fields))),
            lambda item, at: F.struct(
                created.alias("created"),
                (number * CHANGES_PER_HISTORY + at).alias("pos"),
                item["fieldId"].alias("field"),
                item["to"].alias("value"),
                item["toStr"].alias("text"),
                history["author"]["displayName"].alias("author"),
            ),
        )

    return F.flatten(F.transform("changelog.histories", of_history))


def _latest(field: str | None, part: str) -> Column:
    """Text or value of the latest change of a field; later in the document wins a tie.

    A latest change without a value gives null: earlier ones are not looked at.
    """
    if field is None:
        return F.lit(None).cast("string")
    # The struct compares by time first, then by place in the document.
    return F.array_max(F.filter("changes", lambda change: change["field"] == field))[part]


def work_items(
    issues: DataFrame,
    estimate_mapping: Mapping[str, float] | Column,
    estimate_field: str | None = None,
    story_points_field: str | None = None,
    epic_name_field: str | None = None,
    time_mode: str = "wall_clock",
) -> DataFrame:
    """One work item per issue; other columns of ``issues`` (a project) are kept."""
    extra = [name for name in issues.columns if name not in ("key", "fields", "changelog")]
    if not isinstance(estimate_mapping, Column):
        pairs = [F.lit(part) for size, points in estimate_mapping.items() for part in (size, float(points))]
        estimate_mapping = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
    fields = (STATUS_FIELD, VERSION_FIELD, estimate_field, story_points_field, epic_name_field)
    size = _latest(estimate_field, "text")
    points = F.expr("try_cast(storyPoints AS DOUBLE)")
    statuses = F.transform(
        F.filter("changes", lambda change: change["field"] == STATUS_FIELD),
        lambda change: F.struct(
            change["created"].alias("created"),
            change["text"].alias("name"),
            change["author"].alias("author"),
            change["pos"].alias("pos"),
        ),
    )
    return (
        issues.withColumn("changes", _changes_of([name for name in fields if name is not None], time_mode))
        .withColumns({"size": size, "storyPoints": _latest(story_points_field, "text"), "versionText": _latest(VERSION_FIELD, "value")})
        .select(
            *extra,
            F.col("key").alias("id"),
            F.col("fields.summary").alias("name"),
            F.col("fields.issuetype.name").alias("type"),
            F.col("fields.priority.name").alias("priority"),
            parse_time("fields.created", time_mode).alias("created"),
            parse_time("fields.resolutiondate", time_mode).alias("closed"),
            F.col("fields.reporter.displayName").alias("createdBy"),
            "size",
            F.coalesce(F.try_element_at(estimate_mapping, F.col("size")), points, F.lit(0.0)).alias("estimate"),
            statuses.alias("statusHistory"),
            _latest(epic_name_field, "text").alias("epicName"),
            F.expr("try_cast(versionText AS INT)").alias("version"),
        )
    )


def flatten(items: DataFrame) -> DataFrame:
    """One row per status of a work item; items without history give none."""
    extra = [name for name in items.columns if name not in (*ITEM_COLUMNS, "statusHistory", "version")]
    return items.select(*extra, *ITEM_COLUMNS, F.inline("statusHistory").alias("statusCreated", "statusName", "statusAuthor", "pos"))


def with_shared_ids(items: DataFrame, several: DataFrame) -> DataFrame:
    """Mark the items whose ``project`` and ``id`` are in ``several``: their histories are one in reports by item."""
    marks = with_prefix(several.select("project", "id").withColumn(SHARED_ID, F.lit(True)), ("project", "id"))
    marked = items.join(marks, same_keys(("project", "id")), "left")
    return marked.select(*[F.col(f"`{name}`") for name in items.columns], F.coalesce(F.col(SHARED_ID), F.lit(False)).alias(SHARED_ID))


def by_history(items: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Nested items with a history of their own, and flat status rows of histories that are put together by id.

    Flat rows are all of the second kind, and nested items of the first unless they are marked.
    """
    if "statusHistory" not in items.columns:
        return None, items
    if SHARED_ID not in items.columns:
        return items, None
    return items.where(~F.col(SHARED_ID)).drop(SHARED_ID), flatten(items.where(SHARED_ID).drop(SHARED_ID))


def truncate_times(statuses: DataFrame, unit: str) -> DataFrame:
    """Bucket the item and status times, not the closing time."""
    return statuses.withColumns(
        {"created": period_start(unit, "created"), "statusCreated": period_start(unit, "statusCreated")}
    )
