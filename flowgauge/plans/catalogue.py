"""Names, tags and fields of all stored measurements.

The names are fixed: dashboards ask for them. A tag or field has the name of the
report column it comes from, or names that column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.operators.cumulative import change_column
from flowgauge.settings import FlowSpec
from flowgauge.sinks.points import long_form, to_points


@dataclass(frozen=True)
class Measurement:
    name: str
    time: str
    tags: Mapping[str, str]
    fields: Mapping[str, str]
    # Tags that a report sets for all of its rows.
    constant_tags: tuple[str, ...] = ("interval",)

    @property
    def all_tags(self) -> tuple[str, ...]:
        return (*self.constant_tags, *self.tags)

    def points(self, report: DataFrame, **constants: str) -> DataFrame:
        """Points of a report; constant tags may also be columns of it (many series in one job)."""
        fixed = {name: constants[name] for name in self.constant_tags if name in constants}
        columns = {name: name for name in self.constant_tags if name not in constants}
        ordered = to_points(report, self.time, {**columns, **self.tags}, self.fields, fixed)
        return ordered.select("time", *[F.col(f"`{name}`") for name in (*self.all_tags, *self.fields)])

    def long_form(self, points: DataFrame) -> DataFrame:
        return long_form(points, self.name, self.all_tags, tuple(self.fields))


def _columns(*names: str, **renamed: str) -> dict[str, str]:
    """Column of each tag or field: one of the same name, or another one."""
    return {name: name for name in names} | renamed


_SUMS = ("additions", "deletions", "total", "effective")
_RANKS = ("additionsRank", "deletionsRank", "totalRank", "effectiveRank")
_INTERVAL = ("interval",)
_PROJECT = ("project", "interval")
_QUALIFIED = ("project", "qualifier", "interval")

CATALOGUE: dict[str, Measurement] = {
    entry.name: entry
    for entry in (
        # issues
        Measurement(
            "work_items_change_log",
            "time",
            _columns("id", "type", "priority", "changedBy", "status", "epic"),
            _columns("count"),
            _PROJECT,
        ),
        Measurement("work_items_count", "ts", _columns("type", "priority"), _columns("count"), _PROJECT),
        Measurement("state_distinct_authors", "ts", {}, _columns(count="authors"), _QUALIFIED),
        Measurement("team_productivity_factor", "ts", {}, _columns("authors", "totalExperience", "experienceFactor"), _PROJECT),
        Measurement("work_items_count_by_state", "week", _columns(status="statusName"), _columns("count"), _PROJECT),
        Measurement(
            "work_items_count_by_state_moving_average",
            "week",
            _columns(status="statusName"),
            _columns("moving_average"),
            _PROJECT,
        ),
        Measurement("work_items_duration", "created", {}, _columns("min", "max", "mean"), _QUALIFIED),
        # commits
        Measurement(
            "commits",
            "time",
            _columns("project", "namespace", "committer", "projectId"),
            _columns("additions", "deletions", "effective", "total"),
            (),
        ),
        Measurement("namespace_activity_rank", "created", _columns("namespace"), _columns(*_SUMS, *_RANKS), _INTERVAL),
        Measurement("repos_activity_rank", "created", _columns("project"), _columns(*_SUMS, *_RANKS), _INTERVAL),
        Measurement("committers_activity", "created", _columns("committer"), _columns(*_SUMS, *_RANKS), _INTERVAL),
        Measurement("commits_stats", "created", _columns("namespace", "project", "committer"), _columns(*_SUMS), _INTERVAL),
        Measurement("commits_summary", "created", _columns("rootNamespace"), _columns(*_SUMS), _INTERVAL),
        Measurement("commits_by_namespace", "created", _columns("namespace"), _columns(*_SUMS), _INTERVAL),
        Measurement("active_committers", "created", _columns("rootNamespace"), _columns("count"), _INTERVAL),
        Measurement("committer_life_span", "ts", _columns("committer"), _columns("duration"), _INTERVAL),
        Measurement(
            "committer_life_span_stats",
            "ts",
            {},
            _columns(count="durationCount", total="durationTotal", avg="durationAvg", movAvg="durationMovAvg"),
            _INTERVAL,
        ),
        Measurement("commits_stats_by_project_role", "ts", _columns("role"), _columns("additions", "deletions"), _INTERVAL),
        Measurement(
            "commits_stats_by_project_role_namespace",
            "ts",
            _columns("role", "namespace"),
            _columns("additions", "deletions"),
            _INTERVAL,
        ),
        Measurement(
            "commits_stats_by_project_category",
            "ts",
            _columns("category"),
            _columns("additions", "deletions"),
            _INTERVAL,
        ),
        Measurement(
            "commits_stats_by_project_category_namespace",
            "ts",
            _columns("category", "namespace"),
            _columns("additions", "deletions"),
            _INTERVAL,
        ),
        # merge requests
        Measurement(
            "merge_requests",
            "time",
            _columns("id", "project_id", "author", "state", "source_branch", "target_branch"),
            _columns("updated_at", "user_notes_count", "merged_at_ts", "duration_days"),
            (),
        ),
        Measurement(
            "merge_requests_by_state",
            "ts",
            _columns("state", root_namespace="rootNamespace"),
            _columns("count"),
            _INTERVAL,
        ),
        Measurement("merge_requests_by_author", "ts", _columns("author"), _columns("count"), _INTERVAL),
        Measurement(
            "merge_requests_moving_average",
            "ts",
            _columns("state", root_namespace="rootNamespace"),
            _columns("moving_average"),
            _INTERVAL,
        ),
        Measurement("merge_requests_comments", "ts", _columns("author"), _columns("sum"), _INTERVAL),
        Measurement(
            "merge_requests_duration",
            "ts",
            _columns(root_namespace="rootNamespace"),
            _columns("duration_avg", "duration_max", duration_std_dev="std_dev"),
            _INTERVAL,
        ),
        Measurement("merge_requests_authors_ratio", "ts", {}, _columns("ratio", "moving_average"), _INTERVAL),
        Measurement("merge_requests_by_project_role", "ts", _columns("role"), _columns("count"), _INTERVAL),
        Measurement("merge_requests_by_project_category", "ts", _columns("category"), _columns("count"), _INTERVAL),
        Measurement(
            "merge_request_stats_by_project",
            "ts",
            _columns(project="name_with_namespace"),
            _columns("count", "comments"),
            _INTERVAL,
        ),
    )
}

FLOW_TAGS = ("project", "qualifier", "interval")
CFD_COUNT = "cfd_count"
CFD_ESTIMATE = "cfd_estimate"


def flow_measurement(name: str, spec: FlowSpec) -> Measurement:
    """``cfd_count`` or ``cfd_estimate``: fields are named after the two states."""
    fields = {
        "CT": "ct",
        "TH": "th",
        "WIP current": "wip_current",
        "WIP": "wip",
        spec.entry_state: "entry_total",
        spec.final_state: "final_total",
        change_column(spec.entry_state): "entry_change",
        change_column(spec.final_state): "final_change",
    }
    return Measurement(name, "time", {}, fields, _QUALIFIED)


def normalized_flow_measurement(name: str) -> Measurement:
    """The three fields that mean the same whatever the states are called."""
    return Measurement(
        name, "time", {}, {"CT": "ct", "TH": "th", "WIP current": "wip_current"}, _QUALIFIED
    )


def flow_points(table: DataFrame, measurement: Measurement, **constants: str) -> DataFrame:
    """Points of a flow table; a missing throughput is stored as 0."""
    return measurement.points(table.withColumn("th", F.coalesce("th", F.lit(0.0))), **constants)


def tags_of(name: str) -> Sequence[str]:
    return CATALOGUE[name].all_tags
