"""Reports on merge requests.

A stored request has one row per version; every report but the seasonal one uses
the newest version only, and picks it before looking at state or branch.

Reports by project attribute count per project first, so that the join with the
projects never meets more than one row per project and period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions.names import root_namespace
from flowgauge.functions.time import DAYS, days_between, iso_week_number, period_start
from flowgauge.operators.commit_reports import project_tags
from flowgauge.operators.joins import same_keys, with_prefix

MERGED = "merged"

# A table with this column holds newest versions only.
IS_NEWEST = "is_newest"


def latest_versions(requests: DataFrame, newest: Sequence[str] = ()) -> DataFrame:
    """Newest version per ``id`` by ``updatedAt``; ties go to the highest values of ``newest``, then of all columns."""
    if IS_NEWEST in requests.columns:
        return requests
    others = sorted(set(requests.columns) - {"id", "updatedAt", *newest})
    order = [F.col(name).desc() for name in ("updatedAt", *newest, *others)]
    return (
        requests.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
        .where("place = 1")
        .drop("place")
    )


def _newest(
    requests: DataFrame, unit: str, newest: Sequence[str], branch: str | None = None, merged_only: bool = False
) -> DataFrame:
    latest = latest_versions(requests, newest)
    if branch is not None:
        latest = latest.where(F.col("targetBranch") == branch)
    if merged_only:
        latest = latest.where(F.col("state") == MERGED)
    return latest.withColumn("ts", period_start(unit, "createdAt"))


def _project_roots(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").alias("projectId"), root_namespace("name_with_namespace").alias("rootNamespace"))


def by_state(requests: DataFrame, projects: DataFrame, branch: str, unit: str, newest: Sequence[str] = ()) -> DataFrame:
    per_project = _newest(requests, unit, newest, branch).groupBy("ts", "state", "projectId").count()
    return (
        per_project.join(_project_roots(projects), "projectId")
        .groupBy("ts", "state", "rootNamespace")
        .agg(F.sum("count").alias("count"))
    )


def by_author(requests: DataFrame, branch: str, unit: str, newest: Sequence[str] = ()) -> DataFrame:
    return _newest(requests, unit, newest, branch).groupBy("ts", "author").count()


def comments(requests: DataFrame, branch: str, unit: str, newest: Sequence[str] = ()) -> DataFrame:
    return _newest(requests, unit, newest, branch).groupBy("ts", "author").agg(F.sum("userNotesCount").alias("sum"))


def duration(requests: DataFrame, projects: DataFrame, branch: str, unit: str, newest: Sequence[str] = ()) -> DataFrame:
    """Days from creation to merge: mean, longest, population deviation.

    Counted per project and number of days before the join; the moments are then
    exact whole numbers. A merged request without a merge time is not measured.
    """
    days = days_between("createdAt", "mergedAt")
    per_project = _newest(requests, unit, newest, branch, merged_only=True).groupBy(
        "ts", "projectId", days.alias("days")
    ).count()
    n = F.when(F.col("days").isNotNull(), F.col("count")).otherwise(0)
    moments = (
        per_project.join(_project_roots(projects), "projectId")
        .groupBy("ts", "rootNamespace")
        .agg(
            F.sum(n).alias("n"),
            F.sum(F.col("days") * F.col("count")).cast("decimal(19,0)").alias("s"),
            F.sum(F.col("days") * F.col("days") * F.col("count")).cast("decimal(19,0)").alias("q"),
            F.max("days").alias("duration_max"),
        )
    )
    size = F.col("n").cast("decimal(18,0)")
    spread = (size * F.col("q") - F.col("s") * F.col("s")).cast("double")
    return moments.select(
        "ts",
        "rootNamespace",
        F.try_divide(F.col("s").cast("double"), F.col("n")).alias("duration_avg"),
        "duration_max",
        F.try_divide(F.sqrt(spread), F.col("n")).alias("std_dev"),
    )


def authors_ratio(requests: DataFrame, branch: str, unit: str, newest: Sequence[str] = ()) -> DataFrame:
    """Merged requests per author, with the mean of all ratios so far."""
    return (
        _newest(requests, unit, newest, branch, merged_only=True)
        .groupBy("ts", "author")
        .count()
        .groupBy("ts")
        .agg(F.try_divide(F.sum("count"), F.count("author")).alias("ratio"))
        # One row per period here, so a window over all of them stays small.
        .withColumn("moving_average", F.avg("ratio").over(Window.orderBy("ts")))
    )


def moving_average(
    requests: DataFrame, projects: DataFrame, unit: str, newest: Sequence[str] = (), branch: str | None = None
) -> DataFrame:
    """Running mean by state of the counts per period and root namespace.

    The mean at a period takes in all namespaces of that and of earlier periods. It
    is formed from one row per state and period and joined back to the namespaces;
    requests without a state count as a state of their own. No branch means all branches.
    """
    per_project = _newest(requests, unit, newest, branch).groupBy("ts", "state", "projectId").count()
    counts = (
        per_project.join(_project_roots(projects), "projectId")
        .groupBy("ts", "state", "rootNamespace")
        .agg(F.sum("count").alias("count"))
    )
    so_far = Window.partitionBy("state").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    means = (
        counts.groupBy("ts", "state")
        .agg(F.sum("count").alias("requests"), F.count(F.lit(1)).alias("rows"))
        .select(
            "ts", "state", (F.sum("requests").over(so_far) / F.sum("rows").over(so_far)).alias("moving_average")
        )
    )
    keys = ("ts", "state")
    return counts.join(with_prefix(means, keys), same_keys(keys)).select("ts", "state", "moving_average", "rootNamespace")


def _by_tag(
    requests: DataFrame,
    projects: DataFrame,
    vocabulary: DataFrame,
    tag: str,
    branch: str,
    unit: str,
    newest: Sequence[str],
) -> DataFrame:
    per_project = (
        _newest(requests, unit, newest, branch, merged_only=True).groupBy("ts", F.col("projectId").alias("project")).count()
    )
    tags = project_tags(projects, vocabulary, tag).withColumnRenamed("id", "project")
    return per_project.join(tags, "project").groupBy("ts", tag).agg(F.sum("count").alias("count"))


def by_role(
    requests: DataFrame, projects: DataFrame, roles: DataFrame, branch: str, unit: str, newest: Sequence[str] = ()
) -> DataFrame:
    return _by_tag(requests, projects, roles, "role", branch, unit, newest)


def by_category(
    requests: DataFrame, projects: DataFrame, categories: DataFrame, branch: str, unit: str, newest: Sequence[str] = ()
) -> DataFrame:
    return _by_tag(requests, projects, categories, "category", branch, unit, newest)


def stats_by_project(
    requests: DataFrame, projects: DataFrame, branch: str, unit: str, newest: Sequence[str] = ()
) -> DataFrame:
    per_project = (
        _newest(requests, unit, newest, branch, merged_only=True)
        .groupBy("ts", "projectId")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("userNotesCount").alias("comments"))
    )
    names = projects.select(F.col("id").alias("projectId"), "name_with_namespace")
    return (
        per_project.join(names, "projectId")
        .groupBy("ts", "name_with_namespace")
        .agg(F.sum("count").alias("count"), F.sum("comments").alias("comments"))
    )


def seasonality(requests: DataFrame) -> DataFrame:
    """Versions per ISO week of the year: sum, days with any, mean per such day."""
    return (
        requests.groupBy(period_start(DAYS, "createdAt").alias("ts"))
        .count()
        .groupBy(iso_week_number("ts").alias("weekOfYear"))
        .agg(F.sum("count").alias("sum"), F.count("count").alias("count"))
        .withColumn("mean", F.col("sum") / F.col("count"))
        .orderBy("weekOfYear")
    )
