"""Stored reports: from activity tables to points in the metric store."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.time import DAYS, MONTHS, WEEKS
from flowgauge.operators import commit_reports as commits
from flowgauge.operators import cumulative
from flowgauge.operators import issue_reports as issues
from flowgauge.operators import merge_request_reports as requests
from flowgauge.operators.cumulative import COUNT, ESTIMATE
from flowgauge.operators.work_items import flatten, with_shared_ids
from flowgauge.plans.catalogue import CATALOGUE, CFD_COUNT, CFD_ESTIMATE, FLOW_TAGS, flow_measurement, flow_points, tags_of
from flowgauge.session import scratch_path
from flowgauge.settings import FlowReport, FlowSpec
from flowgauge.sinks.metric_store import MetricStore

PROJECT = ("project",)


@dataclass(frozen=True)
class Tables:
    """Inputs of the reports; only those a report needs have to be there.

    ``statuses`` are flat status rows and ``items`` one row per item, both with a
    ``project`` column, so all projects are reported on in one job. ``histories`` are
    items with their statuses nested, from which stays and flows are found within the row;
    without them the flat rows are used.
    """

    statuses: DataFrame | None = None
    items: DataFrame | None = None
    commits: DataFrame | None = None
    merge_requests: DataFrame | None = None
    projects: DataFrame | None = None
    roles: DataFrame | None = None
    categories: DataFrame | None = None
    histories: DataFrame | None = None

    @property
    def by_item(self) -> DataFrame | None:
        return self.statuses if self.histories is None else self.histories


@dataclass(frozen=True)
class Options:
    """Parameters of the reports."""

    unit: str = WEEKS
    as_of: object = None
    branch: str = "develop"
    qualifier: str = "DEV/QA"
    idle_states: Sequence[str] = issues.IDLE_STATES
    learning_time: float = 12.0
    moving_periods: int = 14
    excluded_parts: Sequence[str] = ("-",)
    newest: Sequence[str] = ()
    top_k: int | None = None
    flow: FlowSpec | Mapping[str, FlowSpec] | None = None
    types: Sequence[str] | None = None
    priorities: Sequence[str] | None = None


_BUILDERS: dict[str, Callable[[Tables, Options], DataFrame]] = {
    "work_items_change_log": lambda t, o: issues.change_log(t.statuses, o.unit, PROJECT),
    "work_items_count": lambda t, o: issues.count_by_type_priority(t.items, o.unit, PROJECT),
    "state_distinct_authors": lambda t, o: issues.count_distinct_authors(t.statuses, o.unit, o.idle_states, PROJECT),
    "team_productivity_factor": lambda t, o: issues.team_productivity(
        t.statuses, o.unit, o.learning_time, o.idle_states, PROJECT
    ),
    "work_items_count_by_state": lambda t, o: issues.count_by_state(t.by_item, o.unit, o.as_of, PROJECT),
    "work_items_count_by_state_moving_average": lambda t, o: issues.count_by_state_moving_average(
        t.by_item, o.moving_periods, o.unit, o.as_of, PROJECT
    ),
    "work_items_duration": lambda t, o: cumulative.duration_table(
        t.by_item, o.flow, o.unit, o.types, o.priorities, series=PROJECT
    ),
    "namespace_activity_rank": lambda t, o: commits.namespace_activity_rank(t.commits, o.unit, o.top_k),
    "repos_activity_rank": lambda t, o: commits.repos_activity_rank(t.commits, o.unit, o.top_k),
    "committers_activity": lambda t, o: commits.committers_activity_rank(t.commits, o.unit, o.top_k),
    "commits_stats": lambda t, o: commits.commits_stats(t.commits, o.unit),
    "commits_summary": lambda t, o: commits.commits_summary(t.commits, o.unit),
    "commits_by_namespace": lambda t, o: commits.commits_by_namespace(t.commits, o.unit),
    "active_committers": lambda t, o: commits.active_committers(t.commits, o.unit),
    "committer_life_span": lambda t, o: commits.committers_life_span(t.commits, o.unit, o.excluded_parts),
    "committer_life_span_stats": lambda t, o: commits.committers_life_span_stats(t.commits, o.unit, o.excluded_parts),
    "commits_stats_by_project_role": lambda t, o: commits.commits_by_role(t.projects, t.roles, t.commits, o.unit),
    "commits_stats_by_project_role_namespace": lambda t, o: commits.commits_by_role_namespace(
        t.projects, t.roles, t.commits, o.unit
    ),
    "commits_stats_by_project_category": lambda t, o: commits.commits_by_category(
        t.projects, t.categories, t.commits, o.unit
    ),
    "commits_stats_by_project_category_namespace": lambda t, o: commits.commits_by_category_namespace(
        t.projects, t.categories, t.commits, o.unit
    ),
    "merge_requests_by_state": lambda t, o: requests.by_state(t.merge_requests, t.projects, o.branch, o.unit, o.newest),
    "merge_requests_by_author": lambda t, o: requests.by_author(t.merge_requests, o.branch, o.unit, o.newest),
    "merge_requests_moving_average": lambda t, o: requests.moving_average(
        t.merge_requests, t.projects, o.unit, o.newest
    ),
    "merge_requests_comments": lambda t, o: requests.comments(t.merge_requests, o.branch, o.unit, o.newest),
    "merge_requests_duration": lambda t, o: requests.duration(t.merge_requests, t.projects, o.branch, o.unit, o.newest),
    "merge_requests_authors_ratio": lambda t, o: requests.authors_ratio(t.merge_requests, o.branch, o.unit, o.newest),
    "merge_requests_by_project_role": lambda t, o: requests.by_role(
        t.merge_requests, t.projects, t.roles, o.branch, o.unit, o.newest
    ),
    "merge_requests_by_project_category": lambda t, o: requests.by_category(
        t.merge_requests, t.projects, t.categories, o.branch, o.unit, o.newest
    ),
    "merge_request_stats_by_project": lambda t, o: requests.stats_by_project(
        t.merge_requests, t.projects, o.branch, o.unit, o.newest
    ),
}

REPORTS = tuple(_BUILDERS)

# Reports in which the last stay of an item lasts until a given time.
_OPEN_STAYS = ("work_items_count_by_state", "work_items_count_by_state_moving_average")

# Reports on commits, and those of them that look at the ends of a span of commits only.
LIFE_SPANS = ("committer_life_span", "committer_life_span_stats")
ON_COMMITS = (
    "namespace_activity_rank",
    "repos_activity_rank",
    "committers_activity",
    "commits_stats",
    "commits_summary",
    "commits_by_namespace",
    "active_committers",
    "commits_stats_by_project_role",
    "commits_stats_by_project_role_namespace",
    "commits_stats_by_project_category",
    "commits_stats_by_project_category_namespace",
    *LIFE_SPANS,
)

# Reports that ask for namespaces only, and those by tag of a project: these are made from narrower roll-ups.
BY_NAMESPACE = ("namespace_activity_rank", "commits_summary", "commits_by_namespace")
BY_TAG = {
    "role": ("commits_stats_by_project_role", "commits_stats_by_project_role_namespace"),
    "category": ("commits_stats_by_project_category", "commits_stats_by_project_category_namespace"),
}

# The regular runs: report and bucket size.
ISSUE_RUN = (
    ("work_items_count_by_state", WEEKS),
    ("work_items_count_by_state_moving_average", WEEKS),
    ("work_items_count", WEEKS),
    ("state_distinct_authors", MONTHS),
    ("team_productivity_factor", WEEKS),
)
MERGE_REQUEST_RUN = tuple(
    (name, WEEKS)
    for name in (
        "merge_requests_by_state",
        "merge_requests_by_author",
        "merge_requests_comments",
        "merge_requests_moving_average",
        "merge_requests_duration",
        "merge_requests_by_project_role",
        "merge_requests_by_project_category",
        "merge_request_stats_by_project",
    )
)
COMMIT_RUN = (
    ("active_committers", WEEKS),
    ("commits_summary", WEEKS),
    ("commits_stats", WEEKS),
    ("commits_stats_by_project_role", WEEKS),
    ("commits_stats_by_project_category", WEEKS),
    ("commits_stats_by_project_role_namespace", WEEKS),
    ("commits_stats_by_project_category_namespace", WEEKS),
    ("commits_by_namespace", WEEKS),
    ("committer_life_span", MONTHS),
    ("committer_life_span_stats", MONTHS),
)
FLOW_RUN = (
    FlowReport("All stories and bugs", ("Story", "Bug"), None, "In Progress", "Done", WEEKS),
    FlowReport("All stories", ("Story",), None, "In Progress", "Done", WEEKS),
    FlowReport("All bugs", ("Bug",), None, "In Progress", "Done", WEEKS),
    FlowReport("Critical bugs", ("Bug",), ("Critical",), "In Progress", "Done", DAYS),
)


def report_points(name: str, tables: Tables, options: Options) -> DataFrame:
    """Points of one report, ready for the metric store."""
    needed = {"work_items_duration": ("flow",)} | dict.fromkeys(_OPEN_STAYS, ("as_of",))
    missing = [option for option in needed.get(name, ()) if getattr(options, option) is None]
    if missing:
        raise ValueError(f"{name} needs the options {missing}")
    measurement = CATALOGUE[name]
    constants = {"interval": options.unit}
    if "qualifier" in measurement.constant_tags:
        constants["qualifier"] = options.qualifier
    return measurement.points(_BUILDERS[name](tables, options), **constants)


# Normalized items with the reports made of them, and a spec that names the measured states.
_FlowGroup = tuple[list[tuple[DataFrame, list[FlowReport]]], FlowSpec]


def _flow_groups(
    statuses: DataFrame,
    spec: FlowSpec | Mapping[str, FlowSpec],
    reports: Sequence[FlowReport],
    aggregates: Sequence[str],
) -> dict[tuple[str, str], _FlowGroup]:
    """Normalized items of all reports by measured states, with what the aggregates need of them."""
    specs = {None: spec} if isinstance(spec, FlowSpec) else dict(spec)
    if not specs:
        raise ValueError("no flow for any project")
    unknown = F.col("project").isNull() | ~F.col("project").isin(list(specs))
    wanted: dict[tuple[str, str], dict[tuple, list[FlowReport]]] = {}
    for report in reports:
        projects: dict[tuple[str, str], list] = {}
        for project, own in specs.items():
            states = (report.entry_state or own.entry_state, report.final_state or own.final_state)
            projects.setdefault(states, []).append(project)
        for states, of_states in projects.items():
            wanted.setdefault(states, {}).setdefault(tuple(of_states), []).append(report)
    attributes = ("estimate",) if ESTIMATE in aggregates else ()
    groups = {}
    for states, by_projects in wanted.items():
        normalized = []
        for projects, some in by_projects.items():
            if projects == (None,):
                measured, rows = spec.between(*states), statuses
            else:
                measured = {project: specs[project].between(*states) for project in projects}
                rows = statuses.where(F.col("project").isin(list(projects)) | unknown)
            normalized += cumulative.normalized_reports(rows, measured, some, attributes, PROJECT)
        groups[states] = normalized, specs[projects[0]].between(*states)
    return groups


def _group_points(group: _FlowGroup, aggregate: str) -> DataFrame:
    normalized, spec = group
    name = CFD_COUNT if aggregate == COUNT else CFD_ESTIMATE
    return flow_points(cumulative.report_tables(normalized, aggregate, PROJECT), flow_measurement(name, spec))


def flow_report_points(
    statuses: DataFrame,
    spec: FlowSpec | Mapping[str, FlowSpec],
    reports: Sequence[FlowReport] = FLOW_RUN,
    aggregate: str = COUNT,
) -> dict[str, DataFrame]:
    """Cumulative-flow points of all reports; one frame per pair of measured states.

    With one spec per project, a report without states of its own is measured between
    those of each project, and projects of equal states share a frame. A row of a
    project that has no spec, or of none, fails the job of every frame.
    """
    groups = _flow_groups(statuses, spec, reports, (aggregate,))
    return {" -> ".join(states): _group_points(group, aggregate) for states, group in groups.items()}


def _kept(store: MetricStore, name: str, table: DataFrame) -> DataFrame:
    """The table, computed once and read from the shared scratch folder from here on."""
    path = scratch_path(store.spark, name)
    table.write.parquet(path)
    return store.spark.read.parquet(path)


def _with_rollups(store: MetricStore, run: Sequence[tuple[str, str]], tables: Tables) -> dict[str, Tables]:
    """For each report on commits the tables with the narrowest roll-up in place of the commits; none for a single report.

    A roll-up is made from the one before it, and only if several reports share it.
    """
    names = [name for name, _ in run if name in ON_COMMITS]
    if tables.commits is None or len(names) < 2:
        return {}
    # Weeks and months have no bucket size in common but days. Life spans need none.
    units = {unit for name, unit in run if name in ON_COMMITS and name not in LIFE_SPANS}
    unit = units.pop() if len(units) == 1 else DAYS
    full = _kept(store, "commit-rollup", commits.commit_rollup(tables.commits, unit))
    found = dict.fromkeys(names, replace(tables, commits=full))

    def shared(some: Sequence[str]) -> bool:
        return sum(name in some for name in names) > 1

    if shared(LIFE_SPANS):
        by_committer = _kept(store, "committer-rollup", commits.committer_rollup(full))
        found |= dict.fromkeys(LIFE_SPANS, replace(tables, commits=by_committer))
    by_tag = {tag: some for tag, some in BY_TAG.items() if shared(some)}
    if shared((*BY_NAMESPACE, *(name for some in by_tag.values() for name in some))):
        by_project = _kept(store, "project-rollup", commits.project_rollup(full, unit))
        found |= dict.fromkeys(BY_NAMESPACE, replace(tables, commits=by_project))
        for tag, some in by_tag.items():
            # Kept as well, so that Spark knows how small they are before it deals the roll-up for the join.
            words = tables.roles if tag == "role" else tables.categories
            tags = _kept(store, f"{tag}-tags", commits.project_tags(tables.projects, words, tag))
            per_tag = _kept(store, f"{tag}-rollup", commits.tag_rollup(by_project, tags, unit, tag))
            found |= dict.fromkeys(some, replace(tables, commits=per_tag))
    return found


def run_reports(
    store: MetricStore, load_id: int, run: Sequence[tuple[str, str]], tables: Tables, options: Options
) -> None:
    """Write each report of a run as one load.

    If several reports want the newest versions of merge requests, these are found
    once and kept in the shared scratch folder. So are the roll-ups of the commits,
    which are read once for all reports on them.
    """
    if tables.merge_requests is not None and sum(name.startswith("merge_request") for name, _ in run) > 1:
        newest = _kept(store, "newest-merge-requests", requests.latest_versions(tables.merge_requests, options.newest))
        tables = replace(tables, merge_requests=newest.withColumn(requests.IS_NEWEST, F.lit(True)))
    narrowed = _with_rollups(store, run, tables)
    for name, unit in run:
        points = report_points(name, narrowed.get(name, tables), replace(options, unit=unit))
        store.append(points, name, load_id, tags_of(name))


def run_flow_reports(
    store: MetricStore,
    load_id: int,
    statuses: DataFrame,
    spec: FlowSpec | Mapping[str, FlowSpec],
    reports: Sequence[FlowReport] = FLOW_RUN,
    aggregates: Sequence[str] = (COUNT, ESTIMATE),
) -> None:
    """Write the flow reports of all aggregates as one load; statuses are normalized once for all of them."""
    for number, (normalized, measured) in enumerate(_flow_groups(statuses, spec, reports, aggregates).values()):
        if len(aggregates) > 1:
            normalized = [(_kept(store, f"normalized-{number}", items), some) for items, some in normalized]
        for aggregate in aggregates:
            name = CFD_COUNT if aggregate == COUNT else CFD_ESTIMATE
            store.append(_group_points((normalized, measured), aggregate), name, load_id, FLOW_TAGS)


def _histories(store: MetricStore, items: DataFrame) -> DataFrame:
    """The items, marked where several have one id, as these have a history in common."""
    several = _kept(store, "shared-ids", items.groupBy("project", "id").count().where("count > 1").select("project", "id"))
    return items if several.isEmpty() else _kept(store, "marked-items", with_shared_ids(items, several))


def run_issue_reports(
    store: MetricStore,
    load_id: int,
    items: DataFrame,
    spec: FlowSpec | Mapping[str, FlowSpec],
    options: Options,
    reports: Sequence[FlowReport] = FLOW_RUN,
) -> None:
    """From work items, as ``read_work_items`` gives them, to all stored issue reports of one load.

    The items are kept in the shared scratch folder, so landed files are parsed once for all reports.
    """
    items = _kept(store, "work-items", items)
    tables = Tables(statuses=flatten(items), items=items, histories=_histories(store, items))
    run_reports(store, load_id, ISSUE_RUN, tables, options)
    run_reports(store, load_id, (("work_items_duration", WEEKS),), tables, replace(options, flow=spec))
    run_flow_reports(store, load_id, tables.histories, spec, reports)
