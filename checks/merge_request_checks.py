"""Merge-request reports against SQL."""

from __future__ import annotations

from checks import views
from flowgauge.operators import merge_request_reports as reports
from flowgauge.session import scratch_path
from flowgauge.sinks.newest_versions import NewestVersions
from pyspark.sql import functions as F

BRANCH = "develop"
_TS = "CAST(date_trunc('week', createdAt) AS TIMESTAMP) AS ts"
_WITH = f"WITH {views.MERGE_REQUESTS_SQL}, {views.PROJECTS_SQL}"
_MERGED = "targetBranch = 'develop' AND state = 'merged'"


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


def _latest_columns(df):
    return df.drop("revision")


def _by_state_from_buckets(spark, sf_dir):
    """Two overlapping loads kept in buckets by id, the older versions last."""
    versions = views.merge_requests(spark, sf_dir)
    store = NewestVersions(spark, scratch_path(spark, "versions"), 32, views.NEWEST)
    store.append(versions.where("userNotesCount > 2"))
    store.append(versions.where("userNotesCount < 5"))
    return reports.by_state(store.read(), views.projects(spark, sf_dir), BRANCH, "WEEKS")


def queries():
    m, p, newest = views.merge_requests, views.projects, views.NEWEST
    return {
        "merge_requests_latest": lambda s, d: _latest_columns(reports.latest_versions(m(s, d), newest)),
        "merge_requests_by_state": lambda s, d: reports.by_state(m(s, d), p(s, d), BRANCH, "WEEKS", newest),
        "merge_requests_by_state_bucketed": _by_state_from_buckets,
        "merge_requests_by_author": lambda s, d: reports.by_author(m(s, d), BRANCH, "WEEKS", newest),
        "merge_requests_comments": lambda s, d: reports.comments(m(s, d), BRANCH, "WEEKS", newest),
        "merge_requests_duration": lambda s, d: _rounded(
            reports.duration(m(s, d), p(s, d), BRANCH, "WEEKS", newest), "duration_avg", "std_dev"
        ),
        "merge_requests_authors_ratio": lambda s, d: _rounded(
            reports.authors_ratio(m(s, d), BRANCH, "WEEKS", newest), "ratio", "moving_average"
        ),
        "merge_requests_moving_average": lambda s, d: _rounded(
            reports.moving_average(m(s, d), p(s, d), "WEEKS", newest), "moving_average"
        ),
        "merge_requests_moving_average_branch": lambda s, d: _rounded(
            reports.moving_average(m(s, d), p(s, d), "MONTHS", newest, BRANCH), "moving_average"
        ),
        "merge_requests_by_role": lambda s, d: reports.by_role(
            m(s, d), p(s, d), views.roles(s, d), BRANCH, "WEEKS", newest
        ),
        "merge_requests_by_category": lambda s, d: reports.by_category(
            m(s, d), p(s, d), views.categories(s, d), BRANCH, "WEEKS", newest
        ),
        "merge_request_stats_by_project": lambda s, d: reports.stats_by_project(
            m(s, d), p(s, d), BRANCH, "WEEKS", newest
        ),
        "merge_requests_seasonality": lambda s, d: _rounded(reports.seasonality(m(s, d)), "mean"),
    }


def _moving_average_sql(unit: str, where: str) -> str:
    return f"""{_WITH},
counts AS (
  SELECT CAST(date_trunc('{unit}', createdAt) AS TIMESTAMP) AS ts, state, rootNamespace, count(*) AS n
  FROM latest m JOIN projects p ON p.id = m.projectId WHERE {where} GROUP BY ALL)
SELECT ts, state, round(avg(n) OVER (PARTITION BY state ORDER BY ts), 6) AS moving_average, rootNamespace FROM counts"""


def oracle_sql():
    by_state = (
        f'{_WITH} SELECT {_TS}, state, rootNamespace, count(*) AS "count" '
        "FROM latest m JOIN projects p ON p.id = m.projectId WHERE targetBranch = 'develop' GROUP BY ALL"
    )
    return {
        "merge_requests_latest": f"{_WITH} SELECT * EXCLUDE (revision) FROM latest",
        "merge_requests_by_state": by_state,
        "merge_requests_by_state_bucketed": by_state,
        "merge_requests_by_author": (
            f"{_WITH} SELECT {_TS}, author, count(*) AS \"count\" FROM latest WHERE targetBranch = 'develop' GROUP BY ALL"
        ),
        "merge_requests_comments": (
            f"{_WITH} SELECT {_TS}, author, CAST(sum(userNotesCount) AS BIGINT) AS \"sum\" "
            "FROM latest WHERE targetBranch = 'develop' GROUP BY ALL"
        ),
        "merge_requests_duration": f"""{_WITH},
days AS (
  SELECT {_TS}, rootNamespace, date_diff('day', CAST(createdAt AS DATE), CAST(mergedAt AS DATE)) AS days
  FROM latest m JOIN projects p ON p.id = m.projectId WHERE {_MERGED})
SELECT ts, rootNamespace, round(avg(days), 6) AS duration_avg, max(days) AS duration_max,
       round(stddev_pop(days), 6) AS std_dev
FROM days GROUP BY ALL""",
        "merge_requests_authors_ratio": f"""{_WITH},
ratios AS (
  SELECT {_TS}, count(*) / count(DISTINCT author) AS ratio FROM latest WHERE {_MERGED} GROUP BY ALL)
SELECT ts, round(ratio, 6) AS ratio, round(avg(ratio) OVER (ORDER BY ts), 6) AS moving_average FROM ratios""",
        "merge_requests_moving_average": _moving_average_sql("week", "true"),
        "merge_requests_moving_average_branch": _moving_average_sql("month", "targetBranch = 'develop'"),
        "merge_requests_by_role": (
            f'{_WITH} SELECT {_TS}, role, count(*) AS "count" '
            f"FROM latest m JOIN project_roles p ON p.id = m.projectId WHERE {_MERGED} GROUP BY ALL"
        ),
        "merge_requests_by_category": (
            f'{_WITH} SELECT {_TS}, category, count(*) AS "count" '
            f"FROM latest m JOIN project_categories p ON p.id = m.projectId WHERE {_MERGED} GROUP BY ALL"
        ),
        "merge_request_stats_by_project": (
            f'{_WITH} SELECT {_TS}, name_with_namespace, count(*) AS "count", '
            "CAST(sum(userNotesCount) AS BIGINT) AS comments "
            f"FROM latest m JOIN projects p ON p.id = m.projectId WHERE {_MERGED} GROUP BY ALL"
        ),
        "merge_requests_seasonality": f"""{_WITH},
per_day AS (SELECT CAST(createdAt AS DATE) AS day, count(*) AS n FROM merge_requests GROUP BY ALL)
SELECT CAST(weekofyear(day) AS INTEGER) AS weekOfYear, CAST(sum(n) AS BIGINT) AS "sum", count(*) AS "count",
       round(sum(n) / count(*), 6) AS mean
FROM per_day GROUP BY ALL""",
    }
