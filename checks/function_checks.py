"""Scalar functions over whole tables against SQL."""

from __future__ import annotations

from checks import views
from flowgauge.functions import names, time
from pyspark.sql import functions as F

START = "l_shipdate"


def _calendar(spark, sf_dir):
    """Calendar functions on a ship date with a time of day and a later time."""
    rows = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_partkey") % 24).cast("int"))).alias("a"),
        (
            F.col("l_shipdate")
            + F.make_dt_interval(days=(F.col("l_orderkey") % 120).cast("int"), hours=F.col("l_linenumber"))
        ).alias("b"),
    )
    units = {"day": time.DAYS, "week": time.WEEKS, "month": time.MONTHS}
    starts = {f"{name}_start": time.period_start(unit, "a") for name, unit in units.items()}
    of_dates = {f"{name}s_between": time.complete_units(unit, "a", "b") for name, unit in units.items()}
    of_times = {f"{name}s_complete": time.complete_units_of_time(unit, "a", "b") for name, unit in units.items()}
    ranges = {
        f"{name}_range_last": F.try_element_at(time.date_range(unit, "a", "b"), F.lit(-1))
        for name, unit in units.items()
        if name != "month"
    }
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "a", "b",
        *[column.alias(name) for name, column in {**starts, **of_dates, **of_times, **ranges}.items()],
        time.hours_between("a", "b").alias("hours_between"),
        time.weekday_name("a").alias("weekday"),
        time.iso_week_number("a").alias("iso_week"),
        time.time_to_epoch_millis("a").alias("millis"),
        time.epoch_millis_to_time(time.time_to_epoch_millis("b")).alias("back_from_millis"),
    )


def _ranges(spark, sf_dir):
    """All dates of ranges that begin on the day of an order; a fifth of them are reversed and empty."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("a"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 150).cast("int") - 30).alias("b"),
    )

    def listed(unit):
        return F.array_join(F.transform(time.date_range(unit, "a", "b"), lambda at: at.cast("string")), ",")

    return orders.select(
        "o_orderkey", "a", "b", listed(time.MONTHS).alias("months"), listed(time.WEEKS).alias("weeks"),
        F.size(time.date_range(time.DAYS, "a", "b")).alias("n_days"),
    )


def _parsing(spark, sf_dir):
    issues = views.issues(spark, sf_dir)
    return issues.select(
        "key",
        time.parse_wall_clock("fields.created").alias("wall_clock"),
        time.parse_instant("fields.created").alias("instant"),
        time.parse_date(F.substring("fields.created", 1, 10)).alias("day"),
        time.or_as_of(time.parse_wall_clock("fields.resolutiondate"), views.AS_OF).alias("until"),
    )


def _naming(spark, sf_dir):
    committer = F.col("committer")
    return views.commits(spark, sf_dir).select(
        "createdAt", "project", "committer", "additions", "deletions",
        names.root_namespace("namespace").alias("root"),
        names.parent_namespace(F.substring_index("project", " / ", -1), "project").alias("parent"),
        names.mapped(committer, views.SETTINGS.email_mapping).alias("mapped"),
        names.mapped_email(F.upper(committer), views.SETTINGS.email_mapping).alias("mapped_email"),
        names.contains_none_of(committer, ("mail-x", "dev1")).alias("wanted"),
        F.round(names.experience_factor("additions", 12.0), 6).alias("experience"),
        names.digest_key(committer).alias("digest"),
    )


def queries():
    return {"calendar_functions": _calendar, "calendar_ranges": _ranges, "time_parsing": _parsing, "name_functions": _naming}


def oracle_sql():
    return {
        "calendar_functions": """
WITH r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate + (l_partkey % 24) * INTERVAL 1 HOUR AS a,
         l_shipdate + (l_orderkey % 120) * INTERVAL 1 DAY + l_linenumber * INTERVAL 1 HOUR AS b
  FROM lineitem)
SELECT *, CAST(date_trunc('day', a) AS TIMESTAMP) AS day_start, CAST(date_trunc('week', a) AS TIMESTAMP) AS week_start,
       CAST(date_trunc('month', a) AS TIMESTAMP) AS month_start,
       date_sub('day', CAST(a AS DATE), CAST(b AS DATE)) AS days_between,
       date_sub('week', CAST(a AS DATE), CAST(b AS DATE)) AS weeks_between,
       CASE WHEN CAST(b AS DATE) > CAST(a AS DATE) THEN (year(b) - year(a)) * 12 + month(b) - month(a)
         - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END ELSE 0 END AS months_between,
       date_sub('day', a, b) AS days_complete, date_sub('week', a, b) AS weeks_complete, 
       CASE WHEN b > a THEN (year(b) - year(a)) * 12 + month(b) - month(a)
         - CASE WHEN (day(b), hour(b)) < (day(a), hour(a)) THEN 1 ELSE 0 END ELSE 0 END AS months_complete,
       CAST(b AS DATE) AS day_range_last,
       CAST(CAST(a AS DATE) + CAST(date_sub('week', CAST(a AS DATE), CAST(b AS DATE)) * 7 AS INTEGER) AS DATE) AS week_range_last,
       date_sub('hour', a, b) AS hours_between, upper(dayname(a)) AS weekday, CAST(weekofyear(a) AS INTEGER) AS iso_week,
       epoch_ms(a) AS millis, b AS back_from_millis
FROM r""",
        # A month later is the same day, or the last one of a shorter month; a month is complete when its day is reached.
        "calendar_ranges": """
WITH r AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a,
         CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 150 - 30 AS INTEGER) AS DATE) AS b FROM orders),
n AS (
  SELECT *, CAST((year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END AS INTEGER) AS n_months
  FROM r)
SELECT o_orderkey, a, b,
       CASE WHEN b < a THEN '' ELSE array_to_string(list_transform(range(0, n_months + 1),
         lambda k: CAST(CAST(a + to_months(CAST(k AS INTEGER)) AS DATE) AS VARCHAR)), ',') END AS months,
       CASE WHEN b < a THEN '' ELSE array_to_string(list_transform(range(0, (b - a) // 7 + 1),
         lambda k: CAST(a + CAST(7 * k AS INTEGER) AS VARCHAR)), ',') END AS weeks,
       CAST(greatest(b - a + 1, 0) AS INTEGER) AS n_days
FROM n""",
        "time_parsing": f"""
SELECT 'I-' || event_id AS "key", date_trunc('second', ts) AS wall_clock, date_trunc('second', ts) - INTERVAL 2 HOUR AS instant,
       CAST(ts AS DATE) AS "day",
       CASE WHEN event_type = 'purchase' THEN date_trunc('second', ts) + INTERVAL 3 DAY ELSE TIMESTAMP '{views.AS_OF}' END AS until
FROM events""",
        "name_functions": f"""
WITH {views.COMMITS_SQL}
SELECT createdAt, project, committer, additions, deletions, rootNamespace AS root, namespace AS parent,
       CASE committer WHEN 'dev1@corp.example' THEN 'dev2@corp.example' WHEN 'dev7@mail-x.example' THEN 'dev8@corp.example'
                      ELSE committer END AS mapped,
       CASE committer WHEN 'dev1@corp.example' THEN 'dev2@corp.example' WHEN 'dev7@mail-x.example' THEN 'dev8@corp.example'
                      ELSE committer END AS mapped_email,
       NOT contains(committer, 'mail-x') AND NOT contains(committer, 'dev1') AS wanted,
       round(least(additions / 12.0::DOUBLE, 1.0), 6) AS experience,
       translate(to_base64(unhex(md5(committer))), '/=', '') AS digest
FROM commits""",
    }
