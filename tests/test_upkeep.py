"""Stored tables that follow their loads: newest versions in buckets, reports of touched periods."""

from datetime import date, datetime

import pytest
from flowgauge.operators import merge_request_reports as requests
from flowgauge.plans import catalogue, reports, upkeep
from flowgauge.sinks.metric_store import MetricStore
from flowgauge.sinks.newest_versions import NewestVersions
from pyspark.sql import functions as F

VERSIONS = "id int, updatedAt long, createdAt timestamp_ntz, state string, targetBranch string, projectId int, author string"
CREATED = datetime(2020, 1, 6)


def versions(spark, *entries):
    rows = [(key, updated, CREATED, state, "develop", 1, "ann") for key, updated, state in entries]
    return spark.createDataFrame(rows, VERSIONS)


LOADS = (
    ((1, 5, "opened"), (1, 7, "closed"), (2, 5, "opened"), (None, 1, "opened"), (3, 1, "opened")),
    ((1, 6, "merged"), (2, 9, "merged"), (4, 1, "opened"), (None, 2, None), (3, 1, "opened")),
)
NEWEST = [(1, "closed"), (2, "merged"), (3, "opened"), (4, "opened"), (None, None)]


def test_newest_of_several_loads(spark, tmp_path, rows):
    store = NewestVersions(spark, str(tmp_path / "v"), 4)
    with pytest.raises(FileNotFoundError):
        store.read()
    for load in LOADS:
        store.append(versions(spark, *load))
    assert rows(store.read(), "id", "state") == NEWEST
    # The same load again changes nothing, and an empty one neither.
    store.append(versions(spark, *LOADS[0]))
    store.append(versions(spark))
    assert rows(store.read(), "id", "state") == NEWEST
    # Another session does not know the table: it is opened from its folder.
    spark.sql(f"DROP TABLE {store.table}")
    again = NewestVersions(spark, str(tmp_path / "v"), 4)
    assert rows(again.read(), "id", "state") == NEWEST
    again.append(versions(spark, (4, 2, "closed")))
    assert rows(again.read().where("id = 4"), "state") == [("closed",)]
    with pytest.raises(ValueError, match="buckets"):
        NewestVersions(spark, str(tmp_path / "v"), 8).read()


def test_buckets_are_read_without_a_shuffle(spark, tmp_path):
    store = NewestVersions(spark, str(tmp_path / "v"), 4)
    for load in LOADS:
        store.append(versions(spark, *load))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    projects = spark.createDataFrame([(1, "a / x")], "id int, name_with_namespace string")
    found = requests.by_state(store.read(), projects, "develop", "WEEKS")
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window ") :]
    assert "Exchange" not in below[: below.index("FileScan")]
    assert found.agg(F.sum("count")).first()[0] == 5


def test_an_id_with_very_many_versions_is_one_row_of_a_load(spark, tmp_path):
    store = NewestVersions(spark, str(tmp_path / "v"), 4)
    many = spark.range(200_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("id"), F.col("id").alias("updatedAt"),
        F.lit(CREATED).cast("timestamp_ntz").alias("createdAt"), F.lit("opened").alias("state"),
        F.lit("develop").alias("targetBranch"), F.lit(1).alias("projectId"), F.lit("ann").alias("author"),
    )
    store.append(many)
    assert spark.read.parquet(store.path).count() == many.select("id").distinct().count()
    assert store.read().where("id = 7").first()["updatedAt"] == 199_998


def test_windows():
    assert upkeep.touched_windows(["2020-02"], "MONTHS") == [(date(2020, 2, 1), date(2020, 2, 29))]
    assert upkeep.touched_windows(["2020-02"], "WEEKS") == [(date(2020, 1, 27), date(2020, 3, 1))]
    assert upkeep.touched_windows(["2019-12", "2020-01", "2020-03"], "DAYS") == [
        (date(2019, 12, 1), date(2020, 1, 31)),
        (date(2020, 3, 1), date(2020, 3, 31)),
    ]
    # Weeks of neighbouring months overlap.
    assert upkeep.touched_windows(["2020-03", "2020-02"], "WEEKS") == [(date(2020, 1, 27), date(2020, 4, 5))]
    assert upkeep.touched_windows([], "WEEKS") == []


COMMITS = "time timestamp_ntz, project string, namespace string, committer string, projectId string, additions int, deletions int, effective int, total int"
RUN = (
    ("commits_summary", "WEEKS"), ("commits_summary", "MONTHS"), ("commits_stats", "WEEKS"), ("active_committers", "MONTHS"),
    ("committers_activity", "MONTHS"),
)


def _commits(spark, start, days, who, lines):
    """A commit a day in each of two projects; every third one without a committer."""
    begin = F.lit(start).cast("timestamp_ntz")
    return spark.range(days * 2).select(
        (begin + F.make_dt_interval(days=F.floor(F.col("id") / 2).cast("int"), hours=F.lit(23))).alias("time"),
        F.concat(F.lit("r / g / p"), (F.col("id") % 2).cast("string")).alias("project"), F.lit("r / g").alias("namespace"),
        F.when(F.col("id") % 3 > 0, who).alias("committer"), (F.col("id") % 2).cast("string").alias("projectId"),
        F.lit(lines).alias("additions"), F.lit(-1).alias("deletions"), F.lit(lines + 1).alias("effective"), F.lit(lines - 1).alias("total"),
    )


def test_refreshed_reports_equal_a_full_run(spark, tmp_path, rows):
    source, target, full = (MetricStore(spark, str(tmp_path / name)) for name in ("source", "target", "full"))
    tags = catalogue.tags_of("commits")
    source.append(_commits(spark, "2019-01-01", 700, "ann", 3), "commits", 1, tags)
    upkeep.refresh_commit_reports(source, target, 1, 0, RUN, reports.Tables(), reports.Options())
    # A few days that were not loaded, and some again with other numbers.
    source.append(_commits(spark, "2020-11-25", 20, "ann", 9), "commits", 2, tags)
    source.append(_commits(spark, "2019-03-30", 3, "bob", 2), "commits", 3, tags)
    assert upkeep.touched_months(source, "commits", 1) == ["2019-03", "2019-04", "2020-11", "2020-12"]
    assert upkeep.touched_commits(source, 1, "WEEKS").count() < 300 < 1400 < upkeep.load_commits(source).count()
    assert upkeep.touched_commits(source, 3, "WEEKS") is None
    upkeep.refresh_commit_reports(source, target, 2, 1, RUN, reports.Tables(), reports.Options())
    before = target.versions("commits_summary")
    upkeep.refresh_commit_reports(source, target, 3, 3, RUN, reports.Tables(), reports.Options())
    assert target.versions("commits_summary") == before
    reports.run_reports(full, 1, RUN, reports.Tables(commits=upkeep.load_commits(source)), reports.Options())
    for name in {name for name, _ in RUN}:
        columns = spark.read.parquet(full.path(name)).columns
        wanted = [column for column in columns if column not in ("load_id", "month", "part")]
        found = rows(target.read(name, catalogue.tags_of(name)), *[F.col(f"`{column}`") for column in wanted])
        assert found == rows(full.read(name, catalogue.tags_of(name)), *[F.col(f"`{column}`") for column in wanted]), name


def test_what_cannot_be_refreshed_is_refused(spark, tmp_path):
    store = MetricStore(spark, str(tmp_path / "s"))
    for run, options in (((("committer_life_span", "MONTHS"),), reports.Options()), (RUN, reports.Options(top_k=3))):
        with pytest.raises(ValueError, match="full run"):
            upkeep.refresh_commit_reports(store, store, 1, 0, run, reports.Tables(), options)
