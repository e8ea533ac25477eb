"""Points, the metric store, the report cache and metric queries against SQL."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from checks import commit_checks, flow_checks, issue_checks, merge_request_checks, source_checks, views
from flowgauge import metric_queries as metrics
from flowgauge.functions.time import as_time
from flowgauge.operators import commit_reports, issue_reports
from flowgauge.plans import catalogue, ingest, reports
from flowgauge.plans.flow_request import FlowRequest, cached_averages, flow_answer, flow_on_request
from flowgauge.plans.upkeep import refresh_commit_reports
from flowgauge.session import scratch_path
from flowgauge.sinks.metric_store import MetricStore
from flowgauge.sinks.points import as_json_rows, to_points
from flowgauge.sinks.report_cache import cached, source_version
from flowgauge.sources import issues, repositories
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOW = "2001-11-05"
OPTIONS = reports.Options(as_of=views.AS_OF, newest=views.NEWEST, idle_states=issue_checks.IDLE, flow=views.FLOW)


def tables(spark, sf_dir) -> reports.Tables:
    statuses = views.statuses(spark, sf_dir)
    return reports.Tables(
        statuses=statuses,
        items=statuses.select("project", "id", "type", "priority", "created").distinct(),
        commits=views.commits(spark, sf_dir),
        merge_requests=views.merge_requests(spark, sf_dir),
        projects=views.projects(spark, sf_dir),
        roles=views.roles(spark, sf_dir),
        categories=views.categories(spark, sf_dir),
    )


def _points(name: str):
    return lambda spark, sf_dir: reports.report_points(name, tables(spark, sf_dir), OPTIONS)


# Measurements whose points are summed per field to compare names and values.
_SUMMED = (
    "work_items_change_log", "work_items_count", "work_items_count_by_state", "commits_stats", "commits_summary",
    "commits_by_namespace", "active_committers", "commits_stats_by_project_role", "commits_stats_by_project_category",
    "merge_requests_by_state", "merge_requests_by_author", "merge_requests_comments", "merge_requests_by_project_role",
    "merge_requests_by_project_category", "merge_request_stats_by_project",
)


def _field_sums(spark, sf_dir):
    inputs = tables(spark, sf_dir)
    long = reduce(
        DataFrame.unionByName,
        [catalogue.CATALOGUE[name].long_form(reports.report_points(name, inputs, OPTIONS)) for name in _SUMMED],
    )
    return (
        long.select("measurement", F.map_keys("tags").alias("names"), F.explode("fields").alias("field", "value"))
        .groupBy("measurement", F.array_join(F.array_sort("names"), ",").alias("tags"), "field")
        .agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("value"))
    )


def _two_loads(spark, sf_dir) -> MetricStore:
    """Weekly sums stored up to 1999, then again from 1998 on: 1998 is loaded twice."""
    store = MetricStore(spark, scratch_path(spark, "metrics"))
    inputs = tables(spark, sf_dir)

    def load(load_id, keep):
        part = reports.Tables(commits=inputs.commits.where(keep))
        store.append(reports.report_points("commits_by_namespace", part, OPTIONS), "commits_by_namespace", load_id, catalogue.tags_of("commits_by_namespace"))

    load(1, F.col("createdAt") < as_time("1999-03-01"))
    load(2, F.col("createdAt") >= as_time("1998-06-01"))
    return store


def _stored(spark, sf_dir):
    return _two_loads(spark, sf_dir).read("commits_by_namespace", catalogue.tags_of("commits_by_namespace"))


def _stored_year(spark, sf_dir):
    return _two_loads(spark, sf_dir).read(
        "commits_by_namespace", catalogue.tags_of("commits_by_namespace"), since="1999-01-01", until="1999-12-31"
    )


def _first_load(spark, sf_dir):
    """The store as it was before the second load, which readers of the first manifest do not see."""
    tags = catalogue.tags_of("commits_by_namespace")
    return _two_loads(spark, sf_dir).read("commits_by_namespace", tags, version=1, loaded_once=True)


def _last_month(spark, sf_dir):
    return _two_loads(spark, sf_dir).last_month("commits_by_namespace").drop("month")


def _compacted(spark, sf_dir):
    store = _two_loads(spark, sf_dir)
    target = MetricStore(spark, scratch_path(spark, "compacted"))
    tags = catalogue.tags_of("commits_by_namespace")
    store.compact("commits_by_namespace", tags, target)
    return target.read("commits_by_namespace", tags)


# Measurements of an issue run that are read back: what tells the rows of a period apart, and the fields.
_RUN_READ = {
    "work_items_count_by_state": ("status", ("count",)),
    "work_items_count": ("concat_ws('/', type, priority)", ("count",)),
    "state_distinct_authors": ("qualifier", ("count",)),
    "cfd_count": ("concat_ws('/', qualifier, interval)", ("CT", "WIP", "WIP current", "view", "purchase")),
    "work_items_duration": ("qualifier", ("min", "max", "mean")),
}


def _issue_run(spark, sf_dir):
    """Landed JSON to work items, all regular reports of one load, and their points read from the store."""
    items = issues.as_work_items(source_checks._landed_issues(spark, sf_dir), views.SETTINGS)
    store = MetricStore(spark, scratch_path(spark, "issue-run"))
    reports.run_issue_reports(store, 1, items, views.FLOW, OPTIONS, views.REPORTS)
    parts = []
    for name, (label, fields) in _RUN_READ.items():
        tags = catalogue.FLOW_TAGS if name == "cfd_count" else catalogue.tags_of(name)
        pairs = [part for field in fields for part in (F.lit(field), F.round(F.col(f"`{field}`").cast("double"), 6))]
        parts.append(
            store.read(name, tags).select(
                F.lit(name).alias("measurement"), "time", "project", F.expr(label).alias("label"),
                F.explode(F.create_map(*pairs)).alias("field", "value"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


# Measurements of a commit run: time of the report, what tells the rows of a period apart, and the query of equal rows.
_COMMIT_READ = {
    "active_committers": ("created", "rootNamespace", "active_committers"),
    "commits_summary": ("created", "rootNamespace", "commits_summary"),
    "commits_stats": ("created", "concat_ws('/', namespace, project, committer)", "commits_stats"),
    "commits_stats_by_project_role": ("ts", "role", "commits_by_role"),
    "commits_stats_by_project_category": ("ts", "category", "commits_by_category"),
    "commits_stats_by_project_role_namespace": ("ts", "concat_ws('/', role, namespace)", "commits_by_role_namespace"),
    "commits_stats_by_project_category_namespace": ("ts", "concat_ws('/', category, namespace)", "commits_by_category_namespace"),
    "commits_by_namespace": ("created", "namespace", "commits_by_namespace"),
    "committer_life_span": ("ts", "committer", "committers_life_span"),
    "committer_life_span_stats": ("ts", "''", "committers_life_span_stats"),
}


def _fields_of(points, name, label, fields):
    """One row per point and field."""
    pairs = [F.struct(F.lit(field).alias("field"), F.round(F.col(f"`{field}`").cast("double"), 6).alias("value")) for field in fields]
    return points.select(F.lit(name).alias("measurement"), "time", F.expr(label).alias("label"), F.inline(F.array(*pairs)).alias("field", "value"))


def _commit_run(spark, sf_dir):
    """All regular reports on commits, made from one roll-up of them, and their points read from the store."""
    store = MetricStore(spark, scratch_path(spark, "commit-run"))
    options = replace(OPTIONS, excluded_parts=commit_checks.EXCLUDED)
    reports.run_reports(store, 1, reports.COMMIT_RUN, tables(spark, sf_dir), options)
    parts = [
        _fields_of(store.read(name, catalogue.tags_of(name)), name, label, catalogue.CATALOGUE[name].fields)
        for name, (_, label, _) in _COMMIT_READ.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# Reports that follow the loads of commits, with their time, label and keys.
_REFRESHED = {
    "commits_summary": ("created", "rootNamespace", "rootNamespace"),
    "commits_by_namespace": ("created", "namespace", "namespace"),
    "active_committers": ("created", "rootNamespace", "rootNamespace"),
}


def _refreshed_commit_reports(spark, sf_dir):
    """Commits loaded up to a day and reported on, then loaded from a little before it on: only touched weeks are new."""
    raw = repositories.read_raw_commits(spark, source_checks._written(spark, "commits", views.raw_commits(spark, sf_dir)))
    source, target = MetricStore(spark, scratch_path(spark, "source")), MetricStore(spark, scratch_path(spark, "reports"))
    run = tuple((name, "WEEKS") for name in _REFRESHED)
    for load_id, window in ((1, ("1990-01-01", "2000-10-11")), (2, ("2000-09-20", "2010-01-01"))):
        ingest.ingest_commits(source, load_id, raw, views.projects(spark, sf_dir), views.SETTINGS, window)
        refresh_commit_reports(source, target, load_id, load_id - 1, run, reports.Tables(), OPTIONS)
    parts = [
        _fields_of(target.read(name, catalogue.tags_of(name)), name, label, catalogue.CATALOGUE[name].fields)
        for name, (_, label, _) in _REFRESHED.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _refreshed_sql() -> str:
    commits = f"SELECT *, split_part(namespace, ' / ', 1) AS rootNamespace FROM ({source_checks.oracle_sql()['commits_through_store']})"
    week = "CAST(date_trunc('week', createdAt) AS TIMESTAMP) AS created"
    sources = {
        name: f"SELECT {week}, {key}, {commit_checks._SUMS}, count(DISTINCT committer) AS \"count\" FROM ({commits}) GROUP BY ALL"
        for name, (_, _, key) in _REFRESHED.items()
    }
    return _fields_sql({name: (time, label, name) for name, (time, label, _) in _REFRESHED.items()}, sources)


# Measurements whose points stand in no other query.
_POINTS_READ = {
    "state_distinct_authors": ("ts", "project", "state_distinct_authors"),
    "team_productivity_factor": ("ts", "project", "team_productivity"),
    "work_items_count_by_state_moving_average": (
        "week", "concat_ws('/', project, status)", "work_items_count_by_state_moving_average",
    ),
    "work_items_duration": ("created", "project", "work_items_duration"),
    "namespace_activity_rank": ("created", "namespace", "namespace_activity_rank"),
    "repos_activity_rank": ("created", "project", "repos_activity_rank"),
    "committers_activity": ("created", "committer", "committers_activity_rank"),
    "merge_requests_moving_average": ("ts", "concat_ws('/', state, root_namespace)", "merge_requests_moving_average"),
    "merge_requests_duration": ("ts", "root_namespace", "merge_requests_duration"),
    "merge_requests_authors_ratio": ("ts", "''", "merge_requests_authors_ratio"),
}
_POINTS_UNITS = {
    "state_distinct_authors": "MONTHS",
    "team_productivity_factor": "DAYS",
    "work_items_count_by_state_moving_average": "DAYS",
    "repos_activity_rank": "MONTHS",
    "committers_activity": "MONTHS",
}


def _report_points(spark, sf_dir):
    inputs = tables(spark, sf_dir)

    def points(name):
        return reports.report_points(name, inputs, replace(OPTIONS, unit=_POINTS_UNITS.get(name, "WEEKS")))

    parts = [
        _fields_of(points(name), name, label, catalogue.CATALOGUE[name].fields)
        for name, (_, label, _) in _POINTS_READ.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _weekly_sketches(spark, name, report, time, tags, count):
    """Weekly distinct counts with their sketches, written to a store and read again."""
    store = MetricStore(spark, scratch_path(spark, "sketches"))
    store.append(to_points(report, time, tags, {"count": count, "sketch": "sketch"}), name, 1, tags)
    return store.read(name, tags)


def _authors_of_four_weeks(spark, sf_dir):
    weekly = issue_reports.count_distinct_authors(
        views.statuses(spark, sf_dir), "WEEKS", issue_checks.IDLE, ("project",), sketch_bits=12
    )
    return metrics.rebucket_distinct(_weekly_sketches(spark, "authors", weekly, "ts", ("project",), "authors"), "4 weeks", ("project",))


def _committers_of_twelve_weeks(spark, sf_dir):
    weekly = commit_reports.active_committers(views.commits(spark, sf_dir), "WEEKS", sketch_bits=14)
    points = _weekly_sketches(spark, "committers", weekly, "created", ("rootNamespace",), "count")
    return metrics.rebucket_distinct(points, "12 weeks", ("rootNamespace",))


REQUEST = FlowRequest("P1", interval="day", types=("Bug", "Story"), start="2024-01-05")
ESTIMATES = FlowRequest("P0", aggregate="estimate", final_state="click")


def _cached_request(spark, sf_dir):
    """Asked for twice: the second answer is read from the first."""
    root = scratch_path(spark, "reports")
    parameters = {"request": REQUEST, "source": source_version(spark, f"{sf_dir}/events.parquet")}

    def build():
        return flow_on_request(views.statuses(spark, sf_dir), views.SETTINGS, REQUEST)

    cached(spark, root, parameters, build)
    return cached(spark, root, parameters, build).withColumn("th", F.round("th", 6))


def _cached_averages(spark, sf_dir):
    """Averages of landed issues, asked for twice."""
    path, root = scratch_path(spark, "issues"), scratch_path(spark, "reports")
    views.issues(spark, sf_dir).write.partitionBy("project").option("ignoreNullFields", "false").json(path)
    cached_averages(spark, path, root, views.SETTINGS, ESTIMATES, issues.LINES)
    return cached_averages(spark, path, root, views.SETTINGS, ESTIMATES, issues.LINES).select(
        *[F.round(name, 6).alias(name) for name in ("avg_th", "avg_ct", "avg_wip_current")]
    )


def _answer(spark, sf_dir):
    return flow_answer(views.statuses(spark, sf_dir), views.SETTINGS, ESTIMATES)


def _flow_points(spark, sf_dir):
    points = reports.flow_report_points(views.statuses(spark, sf_dir), views.FLOW, views.REPORTS)
    return points["view -> purchase"].withColumn("TH", F.round("TH", 6))


def queries():
    stats = _points("commits_stats")
    return {
        "metric_field_sums": _field_sums,
        "issue_run_through_store": _issue_run,
        "commit_run_through_store": _commit_run,
        "commit_reports_refreshed": _refreshed_commit_reports,
        "metric_points_reports": _report_points,
        "flow_request_cached_averages": _cached_averages,
        "metric_points_cfd": _flow_points,
        "metric_points_json": lambda s, d: as_json_rows(
            _points("commits_summary")(s, d).select("rootNamespace", "additions", "deletions", "total")
        ),
        "metric_store_newest": _stored,
        "metric_store_range": _stored_year,
        "metric_store_first_load": _first_load,
        "metric_store_last_month": _last_month,
        "metric_store_compacted": _compacted,
        "flow_request_cached": _cached_request,
        "flow_request_table": lambda s, d: _answer(s, d)[0].withColumn("TH", F.round("TH", 6)),
        "flow_request_averages": lambda s, d: _answer(s, d)[1].select(
            *[F.round(name, 6).alias(name) for name in ("avg_th", "avg_ct", "avg_wip_current")]
        ),
        "query_tags_equal": lambda s, d: metrics.series(
            metrics.tags_equal(_points("merge_requests_by_state")(s, d), interval="WEEKS", root_namespace="root1"),
            ("count",),
            ("state",),
        ),
        "query_tag_matches": lambda s, d: metrics.matching(
            _points("commits_by_namespace")(s, d), {"namespace": r"root[12] / group\d", "interval": "all"}
        ),
        "query_last_months": lambda s, d: metrics.since(_points("commits_by_namespace")(s, d), NOW, months=6),
        "query_last_days": lambda s, d: metrics.since(_points("commits_summary")(s, d), NOW, days=90),
        "query_two_tag_series": lambda s, d: metrics.series(
            _points("commits_stats_by_project_role_namespace")(s, d), ("additions",), ("role", "namespace")
        ),
        "query_pivot_states": lambda s, d: metrics.null_as_zero(
            metrics.one_column_per_value(
                _points("merge_requests_by_state")(s, d), "count", "state", ("merged", "closed", "opened")
            ),
            ("merged", "closed", "opened"),
        ),
        "query_rebucket_four_weeks": lambda s, d: metrics.rebucket(
            _points("work_items_change_log")(s, d), "count", "4 weeks", ("project",)
        ),
        "query_rebucket_committers": lambda s, d: metrics.rebucket(
            metrics.tag_matches(stats(s, d), "namespace", r"root3 / group\d+"), "additions", "30 days", ("committer",)
        ),
        "query_rebucket_authors": _authors_of_four_weeks,
        "query_rebucket_active_committers": _committers_of_twelve_weeks,
        "query_tag_values": lambda s, d: metrics.tag_values(stats(s, d), "namespace"),
        "query_free_filters": lambda s, d: metrics.where_all(
            stats(s, d),
            [("namespace", "=~", "group(3|4)$"), ("project", "!=", "root3 / group3 / repo3"), ("additions", ">", 45)],
        ),
        "query_newest_first": lambda s, d: metrics.newest_first(
            metrics.tags_equal(_flow_points(s, d), qualifier="All bugs", interval="WEEKS", project="P1"),
            ("TH", "CT", "view", "purchase"),
        ),
    }


def _summed_sql() -> str:
    sources = {**issue_checks.oracle_sql(), **commit_checks.oracle_sql(), **merge_request_checks.oracle_sql()}
    renamed = {
        "commits_stats_by_project_role": "commits_by_role",
        "commits_stats_by_project_category": "commits_by_category",
        "merge_requests_by_project_role": "merge_requests_by_role",
        "merge_requests_by_project_category": "merge_requests_by_category",
    }
    parts = []
    for name in _SUMMED:
        measurement = catalogue.CATALOGUE[name]
        tags = ",".join(sorted(measurement.all_tags))
        for field, column in measurement.fields.items():
            parts.append(
                f"SELECT '{name}' AS measurement, '{tags}' AS tags, '{field}' AS field, count(*) AS points, "
                f'CAST(sum("{column}") AS DOUBLE) AS "value" FROM ({sources[renamed.get(name, name)]})'
            )
    return " UNION ALL ".join(parts)


# The statuses of the issues, in place of those of the flat rows.
_ISSUE_STATUSES = f"""{views.ISSUES_SQL}, statuses AS (
  SELECT w.* EXCLUDE (event_id), t AS statusCreated, text_ AS statusName, author AS statusAuthor, pos
  FROM changes c JOIN work_items w ON w.event_id = c.event_id WHERE field = 'status')"""


def _issue_run_sql(cfd: str) -> str:
    """The same reports over the statuses of the issues."""
    by_issue, by_flow = issue_checks.oracle_sql(), flow_checks.oracle_sql()
    sources = {
        "work_items_count_by_state": ("week", "statusName", by_issue["work_items_count_by_state"], {"count": "count"}),
        "work_items_count": ("ts", "concat_ws('/', \"type\", priority)", by_issue["work_items_count"], {"count": "count"}),
        "state_distinct_authors": ("ts", "'DEV/QA'", by_issue["state_distinct_authors"], {"count": "authors"}),
        "cfd_count": ("time", "concat_ws('/', qualifier, \"interval\")", cfd, {f: f for f in _RUN_READ["cfd_count"][1]}),
        "work_items_duration": ("created", "'DEV/QA'", by_flow["work_items_duration"], {f: f for f in ("min", "max", "mean")}),
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS measurement, CAST(\"{time}\" AS TIMESTAMP) AS \"time\", project, {label} AS label, "
        f"'{field}' AS field, round(CAST(\"{column}\" AS DOUBLE), 6) AS \"value\" "
        f"FROM ({sql.replace(views.STATUSES_SQL, _ISSUE_STATUSES)})"
        for name, (time, label, sql, fields) in sources.items()
        for field, column in fields.items()
    )


def _fields_sql(read: dict, sources: dict) -> str:
    """The rows of ``_fields_of`` from the SQL of the reports: tags in a label go by the names of their columns."""
    parts = []
    for name, (time, label, query) in read.items():
        for tag, column in catalogue.CATALOGUE[name].tags.items():
            label = re.sub(rf"\b{tag}\b", f'"{column}"', label)
        parts += [
            f"SELECT '{name}' AS measurement, CAST(\"{time}\" AS TIMESTAMP) AS \"time\", {label} AS label, '{field}' AS field, "
            f'round(CAST("{column}" AS DOUBLE), 6) AS "value" FROM ({sources[query]})'
            for field, column in catalogue.CATALOGUE[name].fields.items()
        ]
    return " UNION ALL ".join(parts)


def oracle_sql():
    commits, requests, flows = commit_checks.oracle_sql(), merge_request_checks.oracle_sql(), flow_checks.oracle_sql()
    weekly = "SELECT created AS \"time\", 'WEEKS' AS \"interval\", * EXCLUDE (created)"
    by_namespace = f"{weekly} FROM ({commits['commits_by_namespace']})"
    # The two loads cut weeks in two: a week of the first load counts only up to its end.
    stored = (
        f"WITH {views.COMMITS_SQL}, loads AS ("
        "SELECT 1 AS load_, * FROM commits WHERE createdAt < TIMESTAMP '1999-03-01' "
        "UNION ALL SELECT 2, * FROM commits WHERE createdAt >= TIMESTAMP '1998-06-01'), "
        f"sums AS (SELECT load_, CAST(date_trunc('week', createdAt) AS TIMESTAMP) AS \"time\", 'WEEKS' AS \"interval\", namespace, "
        f"{commit_checks._SUMS} FROM loads GROUP BY ALL) "
        'SELECT * EXCLUDE (load_) FROM sums QUALIFY row_number() OVER (PARTITION BY "time", namespace ORDER BY load_ DESC) = 1'
    )
    cfd = f"""
SELECT "time", project, qualifier, "interval", ct AS "CT", coalesce(th, 0.0) AS "TH", wip_current AS "WIP current", wip AS "WIP",
       entry_total AS "view", final_total AS "purchase", entry_change AS "view change", final_change AS "purchase change"
FROM ({flows['cfd_reports']})"""
    walk = flow_checks._with(
        flow_checks._walk(
            flow_checks._KINDS, where="project = 'P1' AND \"type\" IN ('Bug', 'Story') AND created > TIMESTAMP '2024-01-05'"
        )
    )
    click = "CASE statusName WHEN 'view' THEN 'E' WHEN 'click' THEN 'F' WHEN 'signup' THEN 'L' WHEN 'purchase' THEN 'O' END"
    answer = flow_checks._with(flow_checks._walk(click, where="project = 'P0'")) + ", " + flow_checks._table(
        "week", "7 DAY", "", "estimate", "DOUBLE"
    )
    averages = (
        f"{answer} SELECT round(avg(CASE WHEN ct > 0 THEN wip / ct END), 6) AS avg_th, round(avg(ct), 6) AS avg_ct, "
        "round(avg(wip_current), 6) AS avg_wip_current FROM t"
    )
    by_state = requests["merge_requests_by_state"]
    stats = f"{weekly} FROM ({commits['commits_stats']})"
    return {
        "metric_field_sums": _summed_sql(),
        "metric_points_cfd": cfd,
        "issue_run_through_store": _issue_run_sql(cfd),
        "commit_run_through_store": _fields_sql(_COMMIT_READ, commits),
        "commit_reports_refreshed": _refreshed_sql(),
        "metric_points_reports": _fields_sql(_POINTS_READ, {**issue_checks.oracle_sql(), **commits, **requests, **flows}),
        "flow_request_cached_averages": averages.replace(views.STATUSES_SQL, _ISSUE_STATUSES),
        "metric_points_json": (
            "SELECT '{\"rootNamespace\":\"' || rootNamespace || '\",\"additions\":' || additions || ',\"deletions\":' || deletions "
            f"|| ',\"total\":' || total || '}}' AS \"value\" FROM ({commits['commits_summary']})"
        ),
        "metric_store_newest": stored,
        "metric_store_range": (
            f"SELECT * FROM ({stored}) WHERE \"time\" BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-12-31'"
        ),
        "metric_store_first_load": (
            f"{weekly} FROM (SELECT CAST(date_trunc('week', createdAt) AS TIMESTAMP) AS created, namespace, {commit_checks._SUMS} "
            f"FROM (WITH {views.COMMITS_SQL} SELECT * FROM commits) WHERE createdAt < TIMESTAMP '1999-03-01' GROUP BY ALL)"
        ),
        "metric_store_last_month": (
            f"WITH last AS ({stored.replace('EXCLUDE (load_) ', '').replace('SELECT *  FROM', 'SELECT * FROM')}) "
            'SELECT * EXCLUDE (load_), CAST(load_ AS BIGINT) AS load_id FROM last '
            "WHERE date_trunc('month', \"time\") = (SELECT max(date_trunc('month', \"time\")) FROM last)"
        ),
        "metric_store_compacted": stored,
        "flow_request_cached": f"{walk}, {flow_checks._table('day', '1 DAY', '')} SELECT * FROM t",
        "flow_request_table": (
            f"{answer} SELECT \"time\" AS \"Time\", entry_change AS \"view change\", final_change AS \"click change\", "
            'entry_total AS "view", final_total AS "click", wip_current AS "WIP current", ct AS "CT", '
            'done_lagged AS "doneLaggedByCT", wip AS "WIP", th AS "TH" FROM t'
        ),
        "flow_request_averages": averages,
        "query_tags_equal": (
            f"SELECT ts AS \"time\", state, \"count\" FROM ({by_state}) WHERE rootNamespace = 'root1'"
        ),
        "query_tag_matches": f"SELECT * FROM ({by_namespace}) WHERE regexp_full_match(namespace, 'root[12] / group[0-9]')",
        "query_last_months": (
            f"SELECT * FROM ({by_namespace}) WHERE \"time\" BETWEEN TIMESTAMP '{NOW}' - INTERVAL 6 MONTH AND TIMESTAMP '{NOW}'"
        ),
        "query_last_days": (
            f"{weekly} FROM ({commits['commits_summary']}) "
            f"WHERE created BETWEEN TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND TIMESTAMP '{NOW}'"
        ),
        "query_two_tag_series": (
            f"SELECT ts AS \"time\", role, namespace, additions FROM ({commits['commits_by_role_namespace']})"
        ),
        "query_pivot_states": (
            'SELECT ts AS "time", '
            + ", ".join(
                f"CAST(coalesce(sum(\"count\") FILTER (state = '{state}'), 0) AS BIGINT) AS {state}"
                for state in ("merged", "closed", "opened")
            )
            + f" FROM ({by_state}) GROUP BY ts"
        ),
        "query_rebucket_four_weeks": (
            "SELECT time_bucket(INTERVAL 28 DAY, \"time\", TIMESTAMP '1970-01-01') AS \"time\", project, "
            f"CAST(sum(\"count\") AS BIGINT) AS \"sum\" FROM ({issue_checks.oracle_sql()['work_items_change_log']}) t GROUP BY 1, 2"
        ),
        "query_rebucket_committers": (
            "SELECT time_bucket(INTERVAL 30 DAY, \"time\", TIMESTAMP '1970-01-01') AS \"time\", committer, "
            f"CAST(sum(additions) AS BIGINT) AS \"sum\" FROM ({stats}) t WHERE regexp_full_match(namespace, 'root3 / group[0-9]+') "
            "GROUP BY 1, 2"
        ),
        # Few enough values for the sketches to be exact.
        "query_rebucket_authors": (
            f"WITH {views.STATUSES_SQL} SELECT time_bucket(INTERVAL 28 DAY, date_trunc('week', statusCreated)::TIMESTAMP, "
            "TIMESTAMP '1970-01-01') AS \"time\", project, count(DISTINCT statusAuthor) AS \"count\" FROM statuses "
            "WHERE statusName NOT IN ('error', 'signup') GROUP BY 1, 2"
        ),
        "query_rebucket_active_committers": (
            f"WITH {views.COMMITS_SQL} SELECT time_bucket(INTERVAL 84 DAY, date_trunc('week', createdAt)::TIMESTAMP, "
            "TIMESTAMP '1970-01-01') AS \"time\", split_part(namespace, ' / ', 1) AS rootNamespace, "
            "count(DISTINCT committer) AS \"count\" FROM commits GROUP BY 1, 2"
        ),
        "query_tag_values": f"SELECT DISTINCT namespace FROM ({commits['commits_stats']})",
        "query_free_filters": (
            f"SELECT * FROM ({stats}) WHERE regexp_matches(namespace, 'group(3|4)$') "
            "AND project <> 'root3 / group3 / repo3' AND additions > 45"
        ),
        "query_newest_first": (
            f'SELECT "time", "TH", "CT", "view", "purchase" FROM ({cfd}) '
            "WHERE qualifier = 'All bugs' AND \"interval\" = 'WEEKS' AND project = 'P1'"
        ),
    }
