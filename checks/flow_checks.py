"""Flow normalization and cumulative flow against SQL.

The SQL walks every history step by step in a recursive query and looks cycle
times up with an as-of join: other ways to the same rows than the operators use.
"""

from __future__ import annotations

from checks import views
from flowgauge.operators import cumulative, flow
from pyspark.sql import functions as F

_SERIES = ("project",)
_FLOWS = {"P0": views.FLOW, "P1": views.MAPPED_FLOW, "P2": views.FLOW}


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


def _normalized(spark, sf_dir, spec):
    return flow.normalize_statuses(views.statuses(spark, sf_dir), spec, ("project", "id"), ("type", "estimate"))


def queries():
    st = views.statuses
    return {
        "normalized_flow": lambda s, d: _normalized(s, d, views.FLOW),
        "normalized_flow_mapped_states": lambda s, d: _normalized(s, d, views.MAPPED_FLOW),
        # The same with histories cut into longer spans.
        "normalized_flow_cut_histories": lambda s, d: flow.normalize_statuses(
            st(s, d), views.FLOW, ("project", "id"), ("type", "estimate"), span_minutes=100_000
        ),
        "normalized_flow_per_project": lambda s, d: flow.normalize_statuses(
            st(s, d), _FLOWS, ("project", "id")
        ),
        "flow_steps": lambda s, d: flow.flow_steps(
            flow.normalize_statuses(st(s, d), views.FLOW, ("project", "id")), views.FLOW
        ),
        "flow_period_changes": lambda s, d: cumulative.period_changes(
            _normalized(s, d, views.FLOW), "WEEKS", series=_SERIES
        ),
        "cfd_count_daily": lambda s, d: _rounded(cumulative.flow_table(st(s, d), views.FLOW, "DAYS"), "th"),
        "cfd_count_daily_by_project": lambda s, d: _rounded(
            cumulative.flow_table(st(s, d), views.FLOW, "DAYS", series=_SERIES), "th"
        ),
        "cfd_estimate_daily": lambda s, d: _rounded(
            cumulative.flow_table(st(s, d), views.FLOW, "DAYS", aggregate="estimate", series=_SERIES), "th"
        ),
        "cfd_count_monthly_by_project": lambda s, d: _rounded(
            cumulative.flow_table(st(s, d), views.FLOW, "MONTHS", series=_SERIES), "th"
        ),
        # Tenths have no exact binary form; sums are exact all the same.
        "cfd_estimate_in_tenths": lambda s, d: _rounded(
            cumulative.flow_table(
                st(s, d).withColumn("estimate", F.col("estimate") * 0.1), views.FLOW, "DAYS", aggregate="estimate", series=_SERIES
            ),
            "th",
        ),
        "cfd_filtered_weekly": lambda s, d: _rounded(
            cumulative.flow_table(
                st(s, d), views.FLOW, "WEEKS", types=("Bug",), priorities=("Critical", "Low"), created_after="2024-01-08"
            ),
            "th",
        ),
        "cfd_reports": lambda s, d: _rounded(
            cumulative.flow_tables(st(s, d), views.FLOW, views.REPORTS, series=_SERIES), "th"
        ),
        "cfd_reports_per_project": lambda s, d: _rounded(
            cumulative.flow_tables(st(s, d), _FLOWS, views.REPORTS, series=_SERIES), "th"
        ),
        "work_items_duration_per_project": lambda s, d: _rounded(
            cumulative.duration_table(st(s, d), _FLOWS, "WEEKS", series=_SERIES), "mean"
        ),
        "cfd_report_columns": lambda s, d: _rounded(
            cumulative.with_report_columns(cumulative.flow_table(st(s, d), views.MAPPED_FLOW, "DAYS"), views.MAPPED_FLOW), "TH"
        ),
        "cfd_averages": lambda s, d: _rounded(
            cumulative.averages(cumulative.flow_table(st(s, d), views.FLOW, "DAYS", series=_SERIES), _SERIES),
            "avg_th", "avg_ct", "avg_wip_current",
        ),
        "work_items_duration": lambda s, d: _rounded(
            cumulative.duration_table(st(s, d), views.FLOW, "WEEKS", series=_SERIES), "mean"
        ),
        "work_items_duration_user": lambda s, d: _rounded(
            cumulative.item_durations(
                flow.normalize_statuses(
                    st(s, d).withColumn("id", F.substring_index("id", "-", 1)), views.FLOW, ("project", "id")
                ),
                "DAYS",
                _SERIES,
            ),
            "mean",
        ),
    }


def _walk(kinds: str, where: str = "true", item: str = "id", name: str = "normalized") -> str:
    """Recursive walk. ``kinds`` is a CASE giving E, F, L (below entry) or O."""
    return f"""
{name}_rows AS (
  SELECT project, {item} AS id, "type", priority, estimate, created, kind, statusCreated AS t,
         row_number() OVER (PARTITION BY {item} ORDER BY statusCreated, pos) AS rn
  FROM (SELECT *, {kinds} AS kind FROM statuses WHERE {where}) WHERE kind IS NOT NULL),
{name}_walk AS (
  SELECT id, rn, CASE WHEN kind = 'E' THEN t END AS e, CAST(NULL AS TIMESTAMP) AS f FROM {name}_rows WHERE rn = 1
  UNION ALL
  SELECT r.id, r.rn,
    CASE WHEN w.e IS NULL THEN CASE WHEN r.kind = 'E' THEN r.t END
         WHEN w.f IS NULL THEN CASE WHEN r.kind = 'L' THEN NULL ELSE w.e END
         WHEN r.kind = 'E' THEN w.e END,
    CASE WHEN w.e IS NOT NULL AND w.f IS NULL AND r.kind = 'F' THEN r.t END
  FROM {name}_walk w JOIN {name}_rows r ON r.id = w.id AND r.rn = w.rn + 1),
{name} AS (
  SELECT DISTINCT r.project, w.id, r."type", r.priority, r.estimate, w.e AS entry_at, w.f AS final_at
  FROM (SELECT * FROM {name}_walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1) w
  JOIN {name}_rows r ON r.id = w.id AND r.rn = 1 WHERE w.e IS NOT NULL)
"""


_KINDS = "CASE statusName WHEN 'view' THEN 'E' WHEN 'purchase' THEN 'F' WHEN 'signup' THEN 'L' WHEN 'click' THEN 'O' END"
_MAPPED_KINDS = (
    "CASE statusName WHEN 'view' THEN 'E' WHEN 'click' THEN 'F' WHEN 'signup' THEN 'L' WHEN 'error' THEN 'L' "
    "WHEN 'purchase' THEN 'O' END"
)


_P0_P2 = "project IN ('P0', 'P2')"
_USER = "split_part(id, '-', 1)"


def _with(walk: str) -> str:
    return f"WITH RECURSIVE {views.STATUSES_SQL}, {walk}"


def _table(unit: str, step: str, series: str, weight: str = "1", number: str = "BIGINT", source: str = "normalized", name: str = "t") -> str:
    """Flow table ``{name}`` of ``source``; ``series`` is a column list ending in a comma, or empty."""
    partition = f"PARTITION BY {series.rstrip(', ')}" if series else ""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in series.split(",") if c.strip())
    both = f"{on} AND " if on else ""
    prefix = "".join(f"a.{c.strip()}, " for c in series.split(",") if c.strip())
    return f"""
{name}_steps AS (
  SELECT {series} entry_at AS at_, 0 AS is_final, {weight} AS w FROM {source}
  UNION ALL SELECT {series} final_at, 1, {weight} FROM {source} WHERE final_at IS NOT NULL),
{name}_values AS (
  SELECT {series} CAST(date_trunc('{unit}', at_) AS TIMESTAMP) AS p,
         CAST(coalesce(sum(w) FILTER (is_final = 0), 0) AS {number}) AS ec, CAST(coalesce(sum(w) FILTER (is_final = 1), 0) AS {number}) AS fc
  FROM {name}_steps GROUP BY ALL),
{name}_spine AS (
  SELECT {series} unnest(generate_series(lo, hi, INTERVAL {step})) AS p
  FROM (SELECT {series} min(p) AS lo, max(p) AS hi FROM {name}_values GROUP BY ALL)),
{name}_filled AS (
  SELECT {prefix} a.p, coalesce(ec, 0) AS ec, coalesce(fc, 0) AS fc
  FROM {name}_spine a LEFT JOIN {name}_values b ON {both} a.p = b.p),
{name}_totals AS (
  SELECT *, CAST(sum(ec) OVER w AS {number}) AS et, CAST(sum(fc) OVER w AS {number}) AS ft
  FROM {name}_filled WINDOW w AS ({partition} ORDER BY p)),
{name}_offers AS (SELECT {series} et AS k, max(p) AS p, max_by(ft, p) AS ft FROM {name}_totals GROUP BY ALL),
{name}_found AS (
  SELECT a.*, b.p AS found_at, coalesce(CAST(b.ft AS DOUBLE), 0.0) AS lagged
  FROM {name}_totals a ASOF LEFT JOIN {name}_offers b ON {both} a.ft >= b.k),
{name}_cycle AS (
  SELECT *, CAST(CASE WHEN et = ft THEN 1 WHEN found_at IS NULL THEN 0
                 ELSE date_sub('{unit}', found_at, p) + 1 END AS BIGINT) AS ct
  FROM {name}_found),
{name} AS (
  SELECT {series} p AS "time", ec AS entry_change, fc AS final_change, et AS entry_total, ft AS final_total,
         et - ft AS wip_current, ct, lagged AS done_lagged,
         CASE WHEN ct = 1 THEN CAST(fc AS DOUBLE) ELSE CAST(ft AS DOUBLE) - lagged END AS wip,
         round(CASE WHEN ct = 0 THEN NULL
                    ELSE (CASE WHEN ct = 1 THEN CAST(fc AS DOUBLE) ELSE CAST(ft AS DOUBLE) - lagged END) / ct END, 6) AS th
  FROM {name}_cycle)
"""


def _per_project() -> str:
    """Items of projects 0 and 2 walked by one flow, of project 1 by another, as ``normalized``."""
    return (
        f"WITH RECURSIVE {views.STATUSES_SQL}, {_walk(_KINDS, where=_P0_P2, name='n0')}, "
        + _walk(_MAPPED_KINDS, where="project = 'P1'", name="n1")
        + ", normalized AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1)"
    )


def _reports_sql(normalized: str) -> str:
    conditions = {
        "All stories and bugs": "true",
        "All stories": "\"type\" = 'Story'",
        "All bugs": "\"type\" = 'Bug'",
        "Critical bugs": "\"type\" = 'Bug' AND priority = 'Critical'",
    }
    spread = " UNION ALL ".join(
        f"SELECT project, '{name}' AS qualifier, entry_at, final_at FROM normalized WHERE {where}"
        for name, where in conditions.items()
    )
    return (
        f"{normalized}, spread AS ({spread}), "
        "weekly AS (SELECT * FROM spread WHERE qualifier <> 'Critical bugs'), "
        "daily AS (SELECT * FROM spread WHERE qualifier = 'Critical bugs'), "
        f"{_table('week', '7 DAY', 'project, qualifier, ', source='weekly', name='w')}, "
        f"{_table('day', '1 DAY', 'project, qualifier, ', source='daily', name='d')} "
        "SELECT *, 'WEEKS' AS \"interval\" FROM w UNION ALL SELECT *, 'DAYS' FROM d"
    )


def oracle_sql():
    normalized = 'SELECT project, id, "type", estimate, entry_at, final_at FROM normalized'
    daily = _table("day", "1 DAY", "")
    by_project = _table("day", "1 DAY", "project, ")
    durations = """, days AS (
  SELECT project, CAST(date_trunc('{unit}', entry_at) AS TIMESTAMP) AS created,
         date_diff('day', CAST(entry_at AS DATE), CAST(coalesce(final_at, entry_at) AS DATE)) + 1 AS d FROM normalized)
SELECT project, created, round(avg(d), 6) AS mean, min(d) AS "min", max(d) AS "max" FROM days GROUP BY ALL"""
    return {
        "normalized_flow": f"{_with(_walk(_KINDS))} {normalized}",
        "normalized_flow_cut_histories": f"{_with(_walk(_KINDS))} {normalized}",
        "normalized_flow_mapped_states": f"{_with(_walk(_MAPPED_KINDS))} {normalized}",
        "normalized_flow_per_project": f"{_per_project()} SELECT project, id, entry_at, final_at FROM normalized",
        "flow_steps": (
            f"{_with(_walk(_KINDS))} SELECT project, id, 'view' AS status, entry_at AS created FROM normalized "
            "UNION ALL SELECT project, id, 'purchase', final_at FROM normalized WHERE final_at IS NOT NULL"
        ),
        "flow_period_changes": (
            f"{_with(_walk(_KINDS))}, {_table('week', '7 DAY', 'project, ')} "
            "SELECT project, CAST(p AS DATE) AS period, ec AS entry_change, fc AS final_change FROM t_values"
        ),
        "cfd_count_daily": f"{_with(_walk(_KINDS))}, {daily} SELECT * FROM t",
        "cfd_count_daily_by_project": f"{_with(_walk(_KINDS))}, {by_project} SELECT * FROM t",
        "cfd_estimate_daily": (
            f"{_with(_walk(_KINDS))}, {_table('day', '1 DAY', 'project, ', 'estimate', 'DOUBLE')} SELECT * FROM t"
        ),
        "cfd_filtered_weekly": (
            _with(
                _walk(
                    _KINDS,
                    where="\"type\" = 'Bug' AND priority IN ('Critical', 'Low') AND created > TIMESTAMP '2024-01-08'",
                )
            )
            + f", {_table('week', '7 DAY', '')} SELECT * FROM t"
        ),
        "cfd_reports": _reports_sql(_with(_walk(_KINDS))),
        "cfd_reports_per_project": _reports_sql(_per_project()),
        "cfd_count_monthly_by_project": f"{_with(_walk(_KINDS))}, {_table('month', '1 MONTH', 'project, ')} SELECT * FROM t",
        "cfd_estimate_in_tenths": (
            f"{_with(_walk(_KINDS))}, "
            + _table(
                "day", "1 DAY", "project, ", "CAST(estimate AS DECIMAL(10,0)) * CAST(0.1 AS DECIMAL(2,1))", "DECIMAL(30,6)"
            )
            + ' SELECT project, "time", CAST(entry_change AS DOUBLE) AS entry_change, CAST(final_change AS DOUBLE) AS final_change, '
            "CAST(entry_total AS DOUBLE) AS entry_total, CAST(final_total AS DOUBLE) AS final_total, "
            "CAST(wip_current AS DOUBLE) AS wip_current, ct, done_lagged, wip, th FROM t"
        ),
        "work_items_duration_per_project": f"{_per_project()}{durations.format(unit='week')}",
        "cfd_report_columns": (
            f"{_with(_walk(_MAPPED_KINDS))}, {daily} SELECT \"time\" AS \"Time\", entry_change AS \"view change\", "
            'final_change AS "click change", entry_total AS "view", final_total AS "click", wip_current AS "WIP current", '
            'ct AS "CT", done_lagged AS "doneLaggedByCT", wip AS "WIP", th AS "TH" FROM t'
        ),
        "cfd_averages": (
            f"{_with(_walk(_KINDS))}, {by_project} SELECT project, "
            "round(avg(CASE WHEN ct > 0 THEN wip / ct END), 6) AS avg_th, round(avg(ct), 6) AS avg_ct, "
            "round(avg(wip_current), 6) AS avg_wip_current FROM t GROUP BY project"
        ),
        "work_items_duration": f"{_with(_walk(_KINDS))}{durations.format(unit='week')}",
        "work_items_duration_user": (
            f"{_with(_walk(_KINDS, item=_USER))}{durations.format(unit='day')}"
        ),
    }
