"""Commit reports against SQL."""

from __future__ import annotations

from checks import views
from flowgauge.operators import commit_reports as reports
from pyspark.sql import functions as F

EXCLUDED = ("-", "mail-x")

_SUMS = (
    "CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, "
    "CAST(sum(total) AS BIGINT) AS total, CAST(sum(additions) - sum(deletions) AS BIGINT) AS effective"
)
_TRUNC = {"DAYS": "day", "WEEKS": "week", "MONTHS": "month"}


def _period(unit: str, column: str = "createdAt") -> str:
    return f"CAST(date_trunc('{_TRUNC[unit]}', {column}) AS TIMESTAMP)"


def _activity_sql(unit: str, keys: str, extra: str = "") -> str:
    return (
        f"WITH {views.COMMITS_SQL} SELECT {_period(unit)} AS created, {keys}, {_SUMS}{extra} "
        f"FROM commits GROUP BY ALL"
    )


def _rank_sql(unit: str, key: str) -> str:
    ranks = ", ".join(
        f"CAST(dense_rank() OVER (PARTITION BY created ORDER BY {m}) AS INTEGER) AS {m}Rank"
        for m in ("additions", "deletions", "total", "effective")
    )
    return (
        f"WITH {views.COMMITS_SQL}, sums AS (SELECT {_period(unit)} AS created, {key}, {_SUMS} FROM commits GROUP BY ALL) "
        f"SELECT *, {ranks} FROM sums"
    )


def _tag_sql(unit: str, tag: str, source: str, keys: str = "") -> str:
    return (
        f"WITH {views.COMMITS_SQL}, {views.PROJECTS_SQL} SELECT {_period(unit)} AS ts, {tag}{keys}, "
        "CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions "
        f"FROM commits JOIN {source} p ON p.id = projectId GROUP BY ALL"
    )


_LIFE_SPAN = f"""
spans AS (
  SELECT committer, min(createdAt) AS "start", max(createdAt) AS "end" FROM commits
  WHERE NOT contains(committer, '-') AND NOT contains(committer, 'mail-x') GROUP BY committer),
life AS (
  SELECT *, CAST(date_trunc('month', "start") AS TIMESTAMP) AS ts, 
         (year("end") - year("start")) * 12 + month("end") - month("start") + 1
           - CASE WHEN (day("end"), hour("end")) < (day("start"), hour("start")) THEN 1 ELSE 0 END AS duration
  FROM spans WHERE "start" <> "end")
"""


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


def queries():
    c, p = views.commits, views.projects
    return {
        "commits_stats": lambda s, d: reports.commits_stats(c(s, d), "WEEKS"),
        "commits_summary": lambda s, d: reports.commits_summary(c(s, d), "WEEKS"),
        "commits_by_namespace": lambda s, d: reports.commits_by_namespace(c(s, d), "WEEKS"),
        "commits_by_namespace_daily_net": lambda s, d: reports.commits_by_namespace(c(s, d), "DAYS", net=True),
        "active_committers": lambda s, d: reports.active_committers(c(s, d), "WEEKS"),
        "commits_by_role": lambda s, d: reports.commits_by_role(p(s, d), views.roles(s, d), c(s, d), "WEEKS"),
        "commits_by_role_namespace": lambda s, d: reports.commits_by_role_namespace(
            p(s, d), views.roles(s, d), c(s, d), "WEEKS"
        ),
        "commits_by_category": lambda s, d: reports.commits_by_category(
            p(s, d), views.categories(s, d), c(s, d), "WEEKS"
        ),
        "commits_by_category_namespace": lambda s, d: reports.commits_by_category_namespace(
            p(s, d), views.categories(s, d), c(s, d), "WEEKS"
        ),
        "namespace_activity_rank": lambda s, d: reports.namespace_activity_rank(c(s, d), "WEEKS"),
        "repos_activity_rank": lambda s, d: reports.repos_activity_rank(c(s, d), "MONTHS"),
        "committers_activity_rank": lambda s, d: reports.committers_activity_rank(c(s, d), "MONTHS"),
        # Kept under its name; all periods are now ranked in one way.
        "committers_activity_rank_large_periods": lambda s, d: reports.committers_activity_rank(c(s, d), "MONTHS"),
        "committers_activity_top": lambda s, d: reports.committers_activity_rank(c(s, d), "MONTHS", top_k=3),
        "committers_life_span": lambda s, d: reports.committers_life_span(c(s, d), "MONTHS", EXCLUDED),
        "committers_life_span_stats": lambda s, d: _rounded(
            reports.committers_life_span_stats(c(s, d), "MONTHS", EXCLUDED), "durationAvg", "durationMovAvg"
        ),
    }


def oracle_sql():
    return {
        "commits_stats": _activity_sql("WEEKS", "namespace, project, committer"),
        "commits_summary": _activity_sql("WEEKS", "rootNamespace"),
        "commits_by_namespace": _activity_sql("WEEKS", "namespace"),
        "commits_by_namespace_daily_net": _activity_sql(
            "DAYS", "namespace", ", CAST(sum(additions) + sum(deletions) AS BIGINT) AS effective_net"
        ),
        "active_committers": (
            f"WITH {views.COMMITS_SQL} SELECT {_period('WEEKS')} AS created, rootNamespace, "
            'count(DISTINCT committer) AS "count" FROM commits GROUP BY ALL'
        ),
        "commits_by_role": _tag_sql("WEEKS", "role", "project_roles"),
        "commits_by_role_namespace": _tag_sql("WEEKS", "role", "project_roles", ", namespace"),
        "commits_by_category": _tag_sql("WEEKS", "category", "project_categories"),
        "commits_by_category_namespace": _tag_sql("WEEKS", "category", "project_categories", ", namespace"),
        "namespace_activity_rank": _rank_sql("WEEKS", "namespace"),
        "repos_activity_rank": _rank_sql("MONTHS", "project"),
        "committers_activity_rank": _rank_sql("MONTHS", "committer"),
        "committers_activity_rank_large_periods": _rank_sql("MONTHS", "committer"),
        "committers_activity_top": (
            f"SELECT * FROM ({_rank_sql('MONTHS', 'committer')}) "
            "QUALIFY dense_rank() OVER (PARTITION BY created ORDER BY total DESC) <= 3"
        ),
        "committers_life_span": f"WITH {views.COMMITS_SQL}, {_LIFE_SPAN} SELECT * FROM life",
        "committers_life_span_stats": f"""
WITH {views.COMMITS_SQL}, {_LIFE_SPAN},
stats AS (SELECT ts, count(*) AS durationCount, CAST(sum(duration) AS BIGINT) AS durationTotal FROM life GROUP BY ts)
SELECT ts, durationCount, durationTotal, round(durationTotal / durationCount, 6) AS durationAvg,
       round(avg(durationTotal / durationCount) OVER (ORDER BY ts), 6) AS durationMovAvg
FROM stats""",
    }
