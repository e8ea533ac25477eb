"""Issue reports against SQL."""

from __future__ import annotations

from checks import views
from flowgauge.operators import issue_reports as reports
from pyspark.sql import functions as F

IDLE = ("error", "signup")
_WITH = f"WITH {views.STATUSES_SQL}"
_ACTIVE = "statusName NOT IN ('error', 'signup')"


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


def _items(spark, sf_dir):
    """One row per item, from its flat rows."""
    return views.statuses(spark, sf_dir).select("project", "id", "type", "priority", "created").distinct()


def queries():
    st = views.statuses
    return {
        "work_items_change_log": lambda s, d: reports.change_log(st(s, d), "WEEKS", ("project",)),
        "work_items_count": lambda s, d: reports.count_by_type_priority(_items(s, d), "WEEKS", ("project",)),
        "state_distinct_authors": lambda s, d: reports.count_distinct_authors(st(s, d), "MONTHS", IDLE, ("project",)),
        "state_distinct_authors_daily": lambda s, d: reports.count_distinct_authors(st(s, d), "DAYS", IDLE),
        "team_productivity": lambda s, d: _rounded(
            reports.team_productivity(st(s, d), "DAYS", 12.0, IDLE, ("project",)), "totalExperience", "experienceFactor"
        ),
        "state_spans": lambda s, d: reports.state_spans(st(s, d), views.AS_OF),
        "state_spans_cut_histories": lambda s, d: reports.state_spans(st(s, d), views.AS_OF, span_minutes=100_000),
        "work_items_count_by_state": lambda s, d: reports.count_by_state(st(s, d), "WEEKS", views.AS_OF, ("project",)),
        "work_items_count_by_state_daily": lambda s, d: reports.count_by_state(st(s, d), "DAYS", views.AS_OF),
        "work_items_count_by_state_moving_average": lambda s, d: _rounded(
            reports.count_by_state_moving_average(st(s, d), 14, "DAYS", views.AS_OF, ("project",)), "moving_average"
        ),
    }


_SPANS = f"""
spans AS (
  SELECT project, id, statusName, statusCreated AS "start",
         coalesce(lead(statusCreated) OVER (PARTITION BY id ORDER BY statusCreated, pos), TIMESTAMP '{views.AS_OF}') AS "end"
  FROM statuses)
"""


def _by_state(unit: str, step: str, series: str) -> str:
    return f"""
counts AS (
  SELECT {series} week, statusName, count(*) AS "count"
  FROM (SELECT *, unnest(generate_series(date_trunc('{unit}', "start")::TIMESTAMP, date_trunc('{unit}', "end")::TIMESTAMP, INTERVAL {step})) AS week
        FROM spans)
  GROUP BY ALL)
"""


def oracle_sql():
    return {
        "work_items_change_log": f"""{_WITH}
SELECT DISTINCT project, CAST(date_trunc('week', statusCreated) AS TIMESTAMP) AS "time", id, "type", priority,
       coalesce(statusAuthor, '') AS changedBy, statusName AS status, coalesce(epicName, 'No epic') AS epic, 1 AS "count"
FROM statuses""",
        "work_items_count": f"""{_WITH}
SELECT project, "type", priority, CAST(date_trunc('week', created) AS TIMESTAMP) AS ts, count(DISTINCT id) AS "count"
FROM statuses GROUP BY ALL""",
        "state_distinct_authors": f"""{_WITH}
SELECT project, CAST(date_trunc('month', statusCreated) AS TIMESTAMP) AS ts, count(DISTINCT statusAuthor) AS authors
FROM statuses WHERE {_ACTIVE} GROUP BY ALL""",
        "state_distinct_authors_daily": f"""{_WITH}
SELECT CAST(date_trunc('day', statusCreated) AS TIMESTAMP) AS ts, count(DISTINCT statusAuthor) AS authors
FROM statuses WHERE {_ACTIVE} GROUP BY ALL""",
        "team_productivity": f"""{_WITH},
presence AS (SELECT project, statusAuthor AS author, min(created) AS a, max(created) AS b FROM statuses WHERE {_ACTIVE} GROUP BY ALL),
listed AS (SELECT project, author, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM presence),
counted AS (SELECT *, row_number() OVER (PARTITION BY project, author ORDER BY ts) AS n FROM listed),
summed AS (
  SELECT project, ts, count(DISTINCT author) AS authors, sum(CASE WHEN n < 12 THEN n / 12.0::DOUBLE ELSE 1 END) AS total
  FROM counted GROUP BY ALL)
SELECT project, ts, authors, round(total, 6) AS totalExperience, round(total / authors, 6) AS experienceFactor FROM summed""",
        "state_spans": f'{_WITH}, {_SPANS} SELECT id, statusName, "start", "end" FROM spans',
        "state_spans_cut_histories": f'{_WITH}, {_SPANS} SELECT id, statusName, "start", "end" FROM spans',
        "work_items_count_by_state": f"{_WITH}, {_SPANS}, {_by_state('week', '7 DAY', 'project,')} SELECT * FROM counts",
        "work_items_count_by_state_daily": f"{_WITH}, {_SPANS}, {_by_state('day', '1 DAY', '')} SELECT * FROM counts",
        "work_items_count_by_state_moving_average": f"""{_WITH}, {_SPANS}, {_by_state('day', '1 DAY', 'project,')}
SELECT project, week, statusName,
       round(avg("count") OVER (PARTITION BY project, statusName ORDER BY week ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 6)
         AS moving_average
FROM counts""",
    }
