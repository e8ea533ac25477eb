import random
from datetime import datetime

import pytest
from flowgauge.operators import commit_reports as R
from flowgauge.operators.ranking import dense_ranks
from pyspark.sql import functions as F


def commits(spark, *entries):
    """Commits as (day of January, namespace, project, committer, added, removed)."""
    data = [
        (datetime(2020, 1, day, 12), f"{namespace} / {project}", namespace, who, added, -removed, added + removed, int(project))
        for day, namespace, project, who, added, removed in entries
    ]
    return spark.createDataFrame(
        data,
        "createdAt timestamp_ntz, project string, namespace string, committer string, additions int, deletions int, "
        "total int, projectId int",
    )


@pytest.fixture
def some(spark):
    return commits(
        spark,
        (6, "a / x", "1", "ann", 10, 2),
        (7, "a / x", "1", "bob", 5, 1),
        (8, "a / y", "2", "ann", 1, 0),
        (14, "b", "3", "cy", 7, 7),
    )


WEEK1, WEEK2 = datetime(2020, 1, 6), datetime(2020, 1, 13)


def test_sums_and_signs(some, rows):
    assert rows(R.commits_by_namespace(some, "WEEKS", net=True)) == [
        (WEEK2, "b", 7, -7, 14, 14, 0),
        (WEEK1, "a / x", 15, -3, 18, 18, 12),
        (WEEK1, "a / y", 1, 0, 1, 1, 1),
    ]
    assert rows(R.commits_summary(some, "WEEKS"), "created", "rootNamespace", "total") == [(WEEK2, "b", 14), (WEEK1, "a", 19)]
    assert R.commits_stats(some, "WEEKS").count() == 4
    assert rows(R.active_committers(some, "WEEKS")) == [(WEEK2, "b", 1), (WEEK1, "a", 2)]


def test_sums_are_kept_by_coarser_buckets(some):
    for unit in ("DAYS", "WEEKS", "MONTHS"):
        assert R.commits_summary(some, unit).agg(F.sum("total")).first()[0] == 33


def test_tags(spark, some, rows):
    projects = spark.createDataFrame(
        [(1, "1", "a / x / 1", ["ui", "odd"]), (2, "2", "a / y / 2", ["ui", "api"]), (3, "3", "b / 3", [])],
        "id int, name string, name_with_namespace string, tag_list array<string>",
    )
    vocabulary = spark.createDataFrame([("ui",), ("api",), ("unused",)], "value string")
    assert rows(R.commits_by_role(projects, vocabulary, some, "WEEKS")) == [
        (WEEK1, "api", 1, 0),
        (WEEK1, "ui", 16, -3),
    ]
    assert rows(R.commits_by_category_namespace(projects, vocabulary, some, "WEEKS")) == [
        (WEEK1, "api", "a / y", 1, 0),
        (WEEK1, "ui", "a / x", 15, -3),
        (WEEK1, "ui", "a / y", 1, 0),
    ]


def test_ranks_start_with_the_least_active(some, rows):
    assert rows(R.namespace_activity_rank(some, "WEEKS"), "namespace", "additionsRank", "deletionsRank", "totalRank") == [
        ("a / x", 2, 1, 2),
        ("a / y", 1, 2, 1),
        ("b", 1, 1, 1),
    ]
    assert rows(R.namespace_activity_rank(some, "WEEKS", top_k=1), "namespace") == [("a / x",), ("b",)]


@pytest.mark.parametrize("spread", [100, 100_000, 10**12, 2**63 - 1])
def test_ranks_of_large_groups(spark, rows, spread):
    chance = random.Random(3)
    data = [
        (group, n, chance.choice([chance.randint(-9, 9), chance.randint(-spread, spread)]))
        for group, size in (("small", 30), ("large", 400), (None, 60))
        for n in range(size)
    ]
    frame = spark.createDataFrame(data, "g string, n int, v long")
    expected = []
    for group in ("small", "large", None):
        values = [row for row in data if row[0] == group]
        places = {value: place for place, value in enumerate(sorted({row[2] for row in values}), 1)}
        downwards = {value: place for place, value in enumerate(sorted(places, reverse=True), 1)}
        expected += [(*row, places[row[2]], downwards[row[2]]) for row in values]
    ranked = dense_ranks(frame, ("g",), {"up": F.col("v"), "down": -F.col("v")})
    assert rows(ranked) == sorted(expected, key=repr)


def test_life_spans(spark, rows):
    some = commits(
        spark, (1, "a", "1", "ann", 1, 1), (31, "a", "1", "ann", 1, 1), (2, "a", "1", "once", 1, 1), (3, "a", "1", "x-y", 1, 1),
        (9, "a", "1", "x-y", 1, 1), (3, "a", "1", "bob@out.example", 1, 1), (9, "a", "1", "bob@out.example", 1, 1),
    )
    found = R.committers_life_span(some, "WEEKS", ("-", "@out.example"))
    assert rows(found, "committer", "ts", "duration") == [("ann", datetime(2019, 12, 30), 5)]
    stats = R.committers_life_span_stats(some, "WEEKS", ("-",))
    assert rows(stats.orderBy("ts"), "durationCount", "durationTotal", "durationAvg", "durationMovAvg") == [
        (2, 6, 3.0, 3.0)
    ]


def test_ranks_keep_equal_rows_and_reject_fractions(spark, rows):
    frame = spark.createDataFrame([("g", 1), ("g", 1), ("g", 3), ("g", None), (None, 1)], "g string, v long")
    assert rows(dense_ranks(frame, ("g",), {"r": F.col("v")})) == sorted(
        [("g", 1, 2), ("g", 1, 2), ("g", 3, 3), ("g", None, 1), (None, 1, 1)], key=repr
    )
    with pytest.raises(ValueError, match="whole numbers"):
        dense_ranks(frame, ("g",), {"r": F.col("v") / 2})
