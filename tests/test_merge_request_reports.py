from datetime import datetime

import pytest
from flowgauge.operators import merge_request_reports as R

WEEK1, WEEK2 = datetime(2020, 1, 6), datetime(2020, 1, 13)


def requests(spark, *entries):
    """Versions as (id, project, author, state, branch, notes, day, merge day, updated)."""
    data = [
        (
            datetime(2020, 1, day, 22), number, project, author, state, "f", branch, notes,
            None if merged is None else datetime(2020, 1, merged, 1), updated,
        )
        for number, project, author, state, branch, notes, day, merged, updated in entries
    ]
    return spark.createDataFrame(
        data,
        "createdAt timestamp_ntz, id int, projectId int, author string, state string, sourceBranch string, "
        "targetBranch string, userNotesCount int, mergedAt timestamp_ntz, updatedAt long",
    )


@pytest.fixture
def some(spark):
    return requests(
        spark,
        (1, 10, "ann", "opened", "develop", 1, 6, None, 100),
        (1, 10, "ann", "merged", "develop", 4, 6, 9, 200),
        (2, 10, "bob", "merged", "develop", 2, 7, 8, 100),
        (3, 20, "ann", "merged", "develop", 0, 8, 14, 100),
        (4, 20, "ann", "merged", "develop", 5, 14, 14, 100),
        # The newest version went elsewhere: an older one into develop does not count.
        (5, 10, "ann", "merged", "develop", 9, 6, 7, 100),
        (5, 10, "ann", "closed", "master", 9, 6, None, 300),
        (6, 10, "dan", "opened", "develop", 3, 14, None, 100),
        (7, 99, "eve", "merged", "develop", 1, 14, 15, 100),
    )


@pytest.fixture
def projects(spark):
    return spark.createDataFrame(
        [(10, "one", "alpha / one", ["ui", "web"]), (20, "two", "beta / sub / two", ["ui"])],
        "id int, name string, name_with_namespace string, tag_list array<string>",
    )


def test_newest_version(some, rows):
    assert rows(R.latest_versions(some).where("id IN (1, 5)"), "id", "state") == [(1, "merged"), (5, "closed")]


def test_ties_are_broken_by_the_given_columns(spark, rows):
    tied = requests(
        spark,
        (1, 10, "a", "opened", "develop", 7, 6, None, 100),
        (1, 10, "a", "merged", "develop", 9, 6, None, 100),
        (1, 10, "a", "closed", "develop", 8, 6, None, 100),
    )
    assert rows(R.latest_versions(tied, ("userNotesCount",)), "state") == [("merged",)]


def test_by_state(some, projects, rows):
    assert rows(R.by_state(some, projects, "develop", "WEEKS")) == [
        (WEEK2, "merged", "beta", 1),
        (WEEK2, "opened", "alpha", 1),
        (WEEK1, "merged", "alpha", 2),
        (WEEK1, "merged", "beta", 1),
    ]


def test_by_author_and_comments(some, rows):
    assert rows(R.by_author(some, "develop", "WEEKS").where("author = 'ann'")) == [(WEEK2, "ann", 1), (WEEK1, "ann", 2)]
    assert rows(R.comments(some, "develop", "WEEKS").where("author = 'ann'")) == [(WEEK2, "ann", 5), (WEEK1, "ann", 4)]


def test_duration(some, projects, rows):
    # Calendar days, whatever the time of day: 3 and 1 in alpha.
    assert rows(R.duration(some, projects, "develop", "WEEKS")) == [
        (WEEK2, "beta", 0.0, 0, 0.0),
        (WEEK1, "alpha", 2.0, 3, 1.0),
        (WEEK1, "beta", 6.0, 6, 0.0),
    ]


def test_merged_without_a_time_is_not_measured(spark, projects, rows):
    odd = requests(spark, (1, 10, "a", "merged", "develop", 0, 6, None, 1), (2, 10, "a", "merged", "develop", 0, 6, 8, 1))
    assert rows(R.duration(odd, projects, "develop", "WEEKS")) == [(WEEK1, "alpha", 2.0, 2, 0.0)]
    alone = requests(spark, (1, 10, "a", "merged", "develop", 0, 6, None, 1))
    assert rows(R.duration(alone, projects, "develop", "WEEKS")) == [(WEEK1, "alpha", None, None, None)]


def test_authors_ratio(some, rows):
    assert rows(R.authors_ratio(some, "develop", "WEEKS").orderBy("ts")) == [(WEEK2, 1.0, 1.25), (WEEK1, 1.5, 1.5)]


def test_moving_average_takes_all_namespaces_so_far(some, projects, rows):
    found = rows(R.moving_average(some, projects, "WEEKS").where("state = 'merged'"), "ts", "rootNamespace", "moving_average")
    assert found == [
        (WEEK2, "beta", pytest.approx(4 / 3)),
        (WEEK1, "alpha", 1.5),
        (WEEK1, "beta", 1.5),
    ]
    assert R.moving_average(some, projects, "WEEKS", branch="master").where("state = 'merged'").count() == 0


def test_tags_and_projects(spark, some, projects, rows):
    vocabulary = spark.createDataFrame([("ui",), ("web",)], "value string")
    assert rows(R.by_role(some, projects, vocabulary, "develop", "WEEKS")) == [
        (WEEK2, "ui", 1),
        (WEEK1, "ui", 3),
        (WEEK1, "web", 2),
    ]
    assert rows(R.stats_by_project(some, projects, "develop", "WEEKS")) == [
        (WEEK2, "beta / sub / two", 1, 5),
        (WEEK1, "alpha / one", 2, 6),
        (WEEK1, "beta / sub / two", 1, 0),
    ]


def test_seasonality_counts_all_versions(some, rows):
    assert rows(R.seasonality(some)) == [(2, 6, 3, 2.0), (3, 3, 1, 3.0)]


def test_requests_without_a_state_are_averaged(spark, projects, rows):
    some = requests(spark, (1, 10, "a", None, "develop", 0, 6, None, 1), (2, 10, "a", "merged", "develop", 0, 6, 7, 1))
    found = R.moving_average(some, projects, "WEEKS")
    assert rows(found, "state", "moving_average") == [("merged", 1.0), (None, 1.0)]


def test_every_week_and_missing_times_have_a_row(spark):
    days = [datetime(2020, 1, 6 + n) for n in range(3)] + [datetime.fromisocalendar(2020, week, 1) for week in range(1, 54)] + [None]
    some = spark.createDataFrame([(day,) for day in days], "createdAt timestamp_ntz")
    found = {row["weekOfYear"]: row["sum"] for row in R.seasonality(some).collect()}
    assert found.keys() == {None, *range(1, 54)} and found[2] == 4


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    some = requests(spark, *[(1, 10, name, "merged", "develop", 0, 6, 7, 5) for name in ("ann", "bob", "cid")])
    for order in (some["author"].asc(), some["author"].desc()):
        ordered = some.orderBy(order).coalesce(1)
        assert [row["author"] for row in R.latest_versions(ordered).collect()] == ["cid"]
