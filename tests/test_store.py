import json
import os
from dataclasses import replace
from datetime import datetime

import pytest
from flowgauge import metric_queries as Q
from flowgauge.operators.flow import normalize_statuses
from flowgauge.plans import catalogue, flow_request, ingest, reports
from flowgauge.settings import FlowReport, FlowSpec, Settings
from flowgauge.sinks.metric_store import MetricStore
from flowgauge.sinks.points import as_json_rows
from flowgauge.sinks.report_cache import cache_key, cached, source_version
from pyspark.sql import functions as F

SCHEMA = "time timestamp_ntz, state string, count long"


def points(spark, *entries):
    """Points as (month, day, state, count) of 2020."""
    return spark.createDataFrame([(datetime(2020, month, day), state, count) for month, day, state, count in entries], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return MetricStore(spark, str(tmp_path / "metrics"))


def test_newest_load_wins(spark, store, rows):
    store.append(points(spark, (1, 1, "open", 1), (1, 1, "done", 2), (2, 1, "open", 3)), "m", 1)
    store.append(points(spark, (1, 1, "open", 9), (3, 1, "open", 4)), "m", 2)
    newest = rows(store.read("m", ("state",)), "time", "state", "count")
    assert newest == [
        (datetime(2020, 1, 1), "done", 2),
        (datetime(2020, 1, 1), "open", 9),
        (datetime(2020, 2, 1), "open", 3),
        (datetime(2020, 3, 1), "open", 4),
    ]
    # The same load again, and an empty one, change nothing.
    store.append(points(spark, (1, 1, "open", 9)), "m", 2)
    store.append(points(spark).where("false"), "m", 3)
    assert rows(store.read("m", ("state",)), "time", "state", "count") == newest
    target = MetricStore(spark, store.root + "-compact")
    store.compact("m", ("state",), target)
    assert rows(target.read("m", ("state",)), "time", "state", "count") == newest
    assert spark.read.parquet(target.path("m")).count() == 4
    plain = target.read("m", ("state",), loaded_once=True)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    assert rows(plain, "time", "state", "count") == newest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_months_of_several_loads_are_searched(spark, store, rows):
    store.append(points(spark, (1, 1, "open", 1), (2, 1, "open", 2), (2, 1, "open", 2)), "m", 1, ("state",))
    store.append(points(spark, (2, 1, "open", 5), (3, 1, "open", 3)), "m", 2, ("state",))
    assert rows(store.read("m", ("state",)), "count") == [(1,), (3,), (5,)]
    assert [entry.month for entry in store.entries("m")] == ["2020-01", "2020-02", "2020-02", "2020-03"]
    for since, until, searched in (("2020-01-01", "2020-01-31", False), ("2020-03-01", None, False), ("2020-02-01", "2020-02-28", True)):
        part = store.read("m", ("state",), since, until)
        assert part.count() == 1
    only = MetricStore(spark, store.root + "-once")
    only.append(points(spark, (1, 1, "open", 1), (1, 1, "open", 1)), "m", 1, ("state",))
    plain = only.read("m", ("state",))
    assert "Exchange" not in _plan(plain) and plain.count() == 1
    # By fewer tags than it was written by, a point may be there twice.
    assert "Window" in _plan(only.read("m", ()))
    with pytest.raises(ValueError, match="several loads"):
        store.read("m", ("state",), loaded_once=True)
    with pytest.raises(FileNotFoundError):
        store.read("other", ("state",))


def test_a_half_written_load_is_not_seen(spark, store, rows, monkeypatch):
    store.append(points(spark, (1, 1, "open", 1)), "m", 1, ("state",))
    # Files without a manifest: what a writer leaves that dies before its commit.
    points(spark, (1, 1, "open", 9)).withColumns({"load_id": F.lit(2).cast("long"), "month": F.lit("2020-01")}).write.partitionBy(
        "month"
    ).parquet(store.path("m") + "/part=lost")
    assert rows(store.read("m", ("state",)), "count") == [(1,)]
    assert store.last_month("m").count() == 1
    # A writer that fails leaves the table as it was.
    monkeypatch.setattr("flowgauge.sinks.metric_store.create_small", lambda *_: False)
    with pytest.raises(RuntimeError, match="committed first"):
        store.append(points(spark, (1, 1, "open", 7)), "m", 3, ("state",))
    monkeypatch.undo()
    assert rows(store.read("m", ("state",)), "count") == [(1,)] and store.versions("m") == [1]


def test_two_writers_at_a_time_both_count(spark, store, rows, monkeypatch):
    from flowgauge.sinks import metric_store

    create, other = metric_store.create_small, MetricStore(spark, store.root)

    def slow(*args):
        monkeypatch.setattr(metric_store, "create_small", create)
        other.append(points(spark, (2, 1, "open", 2)), "m", 2, ("state",))
        return create(*args)

    monkeypatch.setattr(metric_store, "create_small", slow)
    store.append(points(spark, (1, 1, "open", 1)), "m", 1, ("state",))
    assert rows(store.read("m", ("state",)), "count") == [(1,), (2,)] and store.versions("m") == [1, 2]
    assert rows(store.read("m", ("state",), version=1), "count") == [(2,)]


def test_folders_without_a_manifest_are_taken_over(spark, store, rows):
    old = points(spark, (1, 1, "open", 1), (2, 1, "open", 2)).withColumns({"load_id": F.lit(1).cast("long")})
    old.withColumn("month", F.date_format(F.col("time").cast("date"), "yyyy-MM")).write.partitionBy("month").parquet(store.path("m"))
    assert rows(store.read("m", ("state",)), "count") == [(1,), (2,)]
    store.append(points(spark, (2, 1, "open", 7), (3, 1, "open", 3)), "m", 2, ("state",))
    assert rows(store.read("m", ("state",)), "count") == [(1,), (3,), (7,)]


def test_files_with_taken_names(spark, tmp_path):
    from flowgauge.sinks.folders import create_small, names_below, read_small

    path = str(tmp_path / "small" / "a.json")
    assert create_small(spark, path, "é\n") and not create_small(spark, path, "other")
    assert read_small(spark, path) == "é\n"
    assert [name for name in names_below(spark, str(tmp_path / "small")) if not name.startswith(".a.json.")] in (["a.json"], [".a.json.crc", "a.json"], ["a.json", ".a.json.crc"])


def test_an_older_load_does_not_come_back(spark, store, rows):
    store.append(points(spark, (1, 1, "open", 9)), "m", 2)
    store.append(points(spark, (1, 1, "open", 1)), "m", 1)
    assert rows(store.read("m", ("state",)), "count") == [(9,)]


def test_a_missing_tag_is_a_tag(spark, store, rows):
    store.append(points(spark, (1, 1, None, 1)), "m", 1)
    store.append(points(spark, (1, 1, None, 2)), "m", 2)
    assert rows(store.read("m", ("state",)), "count") == [(2,)]


def test_time_range_reads_only_its_months(spark, store, rows):
    store.append(points(spark, *[(month, 15, "open", month) for month in range(1, 13)]), "m", 1)
    part = store.read("m", ("state",), since="2020-03-15", until="2020-04-20")
    assert rows(part, "count") == [(3,), (4,)]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert rows(store.read("m", ("state",), since="2020-12-01"), "count") == [(12,)]


def test_cache_reads_what_it_wrote(spark, tmp_path, rows):
    calls = []

    def build():
        calls.append(1)
        return points(spark, (1, 1, "open", 1))

    root = str(tmp_path / "cache")
    for _ in range(2):
        assert rows(cached(spark, root, {"project": "a", "unit": "DAYS"}, build), "count") == [(1,)]
    assert len(calls) == 1
    cached(spark, root, {"project": "b", "unit": "DAYS"}, build)
    assert len(calls) == 2
    # A write that was not committed is done again.
    for folder in os.listdir(root):
        os.remove(os.path.join(root, folder, "_SUCCESS"))
    cached(spark, root, {"project": "a", "unit": "DAYS"}, build)
    assert len(calls) == 3


def test_cache_key(spark):
    assert cache_key(spark, {"a": 1, "b": 2}) == cache_key(spark, {"b": 2, "a": 1})
    assert cache_key(spark, {"a": 1}) != cache_key(spark, {"a": "1"})
    assert not set(cache_key(spark, {"a": 1})) & set("/=+")


def test_source_version_follows_the_files(spark, tmp_path):
    (tmp_path / "one.json").write_text("[]")
    before = source_version(spark, str(tmp_path))
    assert source_version(spark, str(tmp_path)) == before
    (tmp_path / "two.json").write_text("[1]")
    two = source_version(spark, str(tmp_path))
    assert two != before
    # Rewritten at the same length, with an older time.
    (tmp_path / "one.json").write_text("{}")
    os.utime(tmp_path / "one.json", (1_000_000_000, 1_000_000_000))
    assert source_version(spark, str(tmp_path)) not in (before, two)


def test_catalogue_is_complete():
    assert len(catalogue.CATALOGUE) == 31
    assert set(reports.REPORTS) | {"commits", "merge_requests"} == set(catalogue.CATALOGUE)
    for run in (reports.ISSUE_RUN, reports.COMMIT_RUN, reports.MERGE_REQUEST_RUN):
        assert {name for name, _ in run} <= set(reports.REPORTS)


SPEC = FlowSpec({"Backlog": -1, "To Do": 1, "In Progress": 2, "Done": 6}, "To Do", "Done")


def tables(spark):
    changes = [
        ("p", "1", "n", "Bug", "Critical", 6, "In Progress", "ann"), ("p", "1", "n", "Bug", "Critical", 9, "Done", "ann"),
        ("p", "2", "n", "Story", "Low", 7, "In Progress", "bob"), ("q", "3", "n", "Story", "Low", 8, "In Progress", "bob"),
    ]
    statuses = spark.createDataFrame(
        [(p, i, n, t, prio, datetime(2020, 1, day), 2.0, datetime(2020, 1, day, 9), state, who, None, pos)
         for pos, (p, i, n, t, prio, day, state, who) in enumerate(changes)],
        "project string, id string, name string, type string, priority string, created timestamp_ntz, estimate double, "
        "statusCreated timestamp_ntz, statusName string, statusAuthor string, epicName string, pos long",
    )
    commits = spark.createDataFrame(
        [(datetime(2020, 1, day), "a / x", "a", who, 5, -1, 6, 1) for day, who in ((6, "ann"), (20, "ann"), (8, "bob"))],
        "createdAt timestamp_ntz, project string, namespace string, committer string, additions int, deletions int, total int, projectId int",
    )
    requests = spark.createDataFrame(
        [(datetime(2020, 1, 6), n, 1, "ann", "merged", "f", "develop", n, datetime(2020, 1, 8), n) for n in (1, 2)],
        "createdAt timestamp_ntz, id int, projectId int, author string, state string, sourceBranch string, targetBranch string, "
        "userNotesCount int, mergedAt timestamp_ntz, updatedAt long",
    )
    return reports.Tables(
        statuses=statuses.withColumn("closed", F.lit(None).cast("timestamp_ntz")),
        items=statuses.select("project", "id", "type", "priority", "created").distinct(),
        commits=commits,
        merge_requests=requests,
        projects=spark.createDataFrame([(1, "x", "a / x", ["ui"])], "id int, name string, name_with_namespace string, tag_list array<string>"),
        roles=spark.createDataFrame([("ui",)], "value string"),
        categories=spark.createDataFrame([("ui",)], "value string"),
    )


@pytest.mark.parametrize("name", reports.REPORTS)
def test_every_report_gives_points(spark, name):
    measurement = catalogue.CATALOGUE[name]
    options = reports.Options(as_of="2020-02-01 00:00:00", flow=SPEC.between("In Progress"))
    found = reports.report_points(name, tables(spark), options)
    assert found.columns == ["time", *measurement.all_tags, *measurement.fields]
    kinds = dict(found.dtypes)
    assert kinds["time"] == "timestamp_ntz" and all(kinds[tag] == "string" for tag in measurement.all_tags)
    first = measurement.long_form(found).first()
    assert first["measurement"] == name and set(first["tags"]) == set(measurement.all_tags)
    assert first["tags"]["interval"] == "WEEKS" and all(value is not None for value in first["fields"].values())


def test_a_run_fills_the_store(spark, store, rows):
    run = (("commits_summary", "WEEKS"), ("commits_summary", "MONTHS"), ("merge_requests_by_author", "WEEKS"))
    reports.run_reports(store, 1, run, tables(spark), reports.Options())
    stored = store.read("commits_summary", catalogue.tags_of("commits_summary"))
    assert rows(stored, "interval", "time", "total") == [
        ("MONTHS", datetime(2020, 1, 1), 18),
        ("WEEKS", datetime(2020, 1, 20), 6),
        ("WEEKS", datetime(2020, 1, 6), 12),
    ]
    assert store.read("merge_requests_by_author", catalogue.tags_of("merge_requests_by_author")).count() == 1


def test_flow_run(spark, store, rows):
    wanted = (FlowReport("all", unit="DAYS", entry_state="In Progress"), FlowReport("bugs", ("Bug",), unit="WEEKS", entry_state="In Progress"))
    reports.run_flow_reports(store, 1, tables(spark).statuses, SPEC, wanted)
    tags = catalogue.flow_measurement("cfd_count", SPEC).all_tags
    counts = store.read("cfd_count", tags)
    assert rows(Q.tags_equal(counts, qualifier="bugs", project="p"), "CT", "TH", "In Progress", "Done", "In Progress change") == [(1, 1.0, 1, 1, 1)]
    # Cycle time 0 on the first days: throughput is stored as 0.
    assert rows(Q.tags_equal(counts, qualifier="all", project="p").where("CT = 0"), "TH")[0] == (0.0,)
    assert store.read("cfd_estimate", tags).agg(F.max("In Progress")).first()[0] == 4.0


def test_flow_request(spark, rows):
    settings = Settings({"p": SPEC.between("In Progress")}, {})
    statuses = tables(spark).statuses
    table, averages = flow_request.flow_answer(statuses, settings, flow_request.FlowRequest("p", interval="day"))
    assert table.columns[:2] == ["Time", "In Progress change"] and table.count() == 4
    assert averages.count() == 1
    bugs = flow_request.FlowRequest("p", types=("Bug",), aggregate="sum")
    assert rows(flow_request.flow_on_request(statuses, settings, bugs), "entry_total", "final_total", "ct") == [(2.0, 2.0, 1)]
    none = flow_request.FlowRequest("p", priorities=("High",))
    assert flow_request.flow_on_request(statuses, settings, none).count() == 0


def test_ingest(spark, store, rows):
    raw = spark.createDataFrame(
        [("1", "2020-01-01T00:00:00.000Z", "jenkins", 1), ("2", "2020-01-02T00:00:00.000Z", "ann", 1), ("3", "2022-01-02T00:00:00.000Z", "ann", 1)],
        "id string, created_at string, committer_email string, project_id int",
    ).withColumn("stats", F.expr("named_struct('additions', 1, 'deletions', 1, 'total', 2)"))
    projects = tables(spark).projects
    settings = Settings({}, {"ann": "bob"})
    first = ingest.next_commits(store, "2030-01-01")
    assert first == (datetime(2020, 1, 1), datetime(2021, 1, 1))
    for load in (1, 2):
        ingest.ingest_commits(store, load, raw, projects, settings, first)
    assert rows(ingest.load_commits(store), "createdAt", "committer", "deletions") == [(datetime(2020, 1, 2), "bob", -1)]
    assert ingest.next_commits(store, "2030-01-01") == (datetime(2020, 1, 2), datetime(2021, 1, 2))
    ingest.ingest_commits(store, 3, raw, projects, settings)
    assert ingest.next_commits(store, "2030-01-01")[0] == datetime(2022, 1, 2)
    assert ingest.load_commits(store, since="2021-01-01").count() == 1
    assert ingest.next_merge_requests(store, "2030-01-01")[0] == datetime(2020, 1, 1)


def test_queries(spark, rows):
    some = points(spark, (1, 1, "open", 1), (1, 2, "open", 2), (1, 31, "done", 4), (3, 1, "done", None))
    assert rows(Q.tags_equal(some, state="open"), "count") == [(1,), (2,)]
    # The whole tag has to match, also for alternatives.
    assert rows(Q.tag_matches(some, "state", "ope|don"), "count") == []
    assert rows(Q.tag_matches(some, "state", "op.*|do"), "count") == [(1,), (2,)]
    assert Q.tag_matches(some, "state", "all").count() == 4
    assert rows(Q.since(some, "2020-02-01", days=5), "count") == [(4,)]
    assert rows(Q.since(some, "2020-03-01", months=1), "count") == [(None,)]
    assert rows(Q.null_as_zero(some, ("count",)), "count")[0] == (0,)
    assert rows(Q.tag_values(some, "state")) == [("done",), ("open",)]
    assert [row["count"] for row in Q.newest_first(some, ("count",)).collect()] == [None, 4, 2, 1]
    assert rows(Q.where_all(some, [("count", ">", 1), ("state", "!~", "^d")]), "count") == [(2,)]
    assert rows(Q.rebucket(some, "count", "4 weeks")) == [
        (datetime(2019, 12, 26), 3), (datetime(2020, 1, 23), 4), (datetime(2020, 2, 20), None),
    ]
    wide = Q.one_column_per_value(some, "count", "state", ("open", "closed"))
    assert wide.columns == ["time", "open", "closed"]
    with pytest.raises(ValueError):
        Q.where_all(some, [("count", "~", 1)])


def test_rebucketing_keeps_sums(spark):
    some = points(spark, *[(month, day, "open", month * day) for month in range(1, 13) for day in range(1, 28)])
    total = some.agg(F.sum("count")).first()[0]
    for width in ("4 weeks", "30 days", "1 day"):
        assert Q.rebucket(some, "count", width, ("state",)).agg(F.sum("sum")).first()[0] == total


def test_json_rows(spark):
    assert as_json_rows(points(spark, (1, 1, "open", 1)).select("state", "count")).first()[0] == '{"state":"open","count":1}'


def test_normalized_flow_points(spark, rows):
    table = reports.cumulative.flow_table(tables(spark).statuses, SPEC.between("In Progress"), "WEEKS", series=("project",))
    measurement = catalogue.normalized_flow_measurement("cfd")
    found = catalogue.flow_points(table, measurement, qualifier="all", interval="WEEKS")
    assert found.columns == ["time", "project", "qualifier", "interval", "CT", "TH", "WIP current"]
    assert rows(found, "project", "CT", "TH", "WIP current") == [("p", 0, 0.0, 1), ("q", 0, 0.0, 1)]


def test_points_without_a_time_are_refused(spark, store):
    store.append(points(spark, (1, 1, "open", 1)), "m", 1)
    untimed = points(spark, (2, 1, "open", 1)).withColumn("time", F.lit(None).cast("timestamp_ntz"))
    with pytest.raises(Exception, match="has no time"):
        store.append(untimed, "m", 2)
    # A folder of such points from elsewhere is not taken for the last month.
    untimed.withColumns({"load_id": F.lit(1).cast("long"), "month": F.lit(None).cast("string")}).write.mode("append").partitionBy(
        "month"
    ).parquet(store.path("m"))
    assert [row["time"] for row in store.last_month("m").collect()] == [datetime(2020, 1, 1)]


def test_options_are_checked_when_planning(spark):
    for name, option in (("work_items_count_by_state", "as_of"), ("work_items_duration", "flow")):
        with pytest.raises(ValueError, match=option):
            reports.report_points(name, tables(spark), reports.Options())


def test_one_flow_per_project_in_a_run(spark):
    when = [datetime(2020, 1, 6, hour) for hour in range(4)]
    rows = [(p, p + "1", "Bug", None, 1.0, when[0], when[at], s, at) for p in "ab" for at, s in enumerate(("todo", "doing", "done"))]
    statuses = spark.createDataFrame(
        rows,
        "project string, id string, type string, priority string, estimate double, created timestamp_ntz, "
        "statusCreated timestamp_ntz, statusName string, pos int",
    )
    order = {"todo": 0, "doing": 1, "done": 2}
    specs = {"a": FlowSpec(order, "todo", "done"), "b": FlowSpec(order, "doing", "done")}
    points = reports.flow_report_points(statuses, specs, (FlowReport("All", None, None),))
    assert sorted(points) == ["doing -> done", "todo -> done"]
    found = {key: [row["project"] for row in frame.collect()] for key, frame in points.items()}
    assert found == {"doing -> done": ["b"], "todo -> done": ["a"]}
    with pytest.raises(Exception, match="no flow for project b"):
        normalize_statuses(statuses, {"a": specs["a"]}, ("project", "id")).collect()


@pytest.mark.parametrize("project", ["c", None])
def test_a_project_without_a_flow_fails_every_frame(spark, project):
    when = [datetime(2020, 1, 6, hour) for hour in range(3)]
    rows = [(p, f"{p}1", t, None, 1.0, when[0], when[at], s, at)
            for p, t in (("a", "Bug"), ("b", "Bug"), (project, "Story")) for at, s in enumerate(("todo", "doing", "done"))]
    statuses = spark.createDataFrame(
        rows,
        "project string, id string, type string, priority string, estimate double, created timestamp_ntz, "
        "statusCreated timestamp_ntz, statusName string, pos int",
    )
    order = {"todo": 0, "doing": 1, "done": 2}
    specs = {"a": FlowSpec(order, "todo", "done"), "b": FlowSpec(order, "doing", "done")}
    points = reports.flow_report_points(statuses, specs, (FlowReport("Bugs", ("Bug",), None), FlowReport("All", None, None)))
    assert sorted(points) == ["doing -> done", "todo -> done"]
    for frame in points.values():
        with pytest.raises(Exception, match=f"no flow for project {project or 'null'}"):
            frame.collect()
    with pytest.raises(ValueError, match="no flow"):
        reports.flow_report_points(statuses, {})


def test_issue_run_fills_the_store(spark, store):
    history = [(datetime(2020, 1, 6, 9), "todo", "ann", 0), (datetime(2020, 1, 8, 9), "done", "bob", 1)]
    items = spark.createDataFrame(
        [("a", "a1", "n", "Bug", "High", datetime(2020, 1, 6), None, "ann", "S", 1.0, history, None, None)],
        "project string, id string, name string, type string, priority string, created timestamp_ntz, closed timestamp_ntz, "
        "createdBy string, size string, estimate double, "
        "statusHistory array<struct<created:timestamp_ntz,name:string,author:string,pos:bigint>>, epicName string, version int",
    )
    spec = {"a": FlowSpec({"todo": 0, "done": 1}, "todo", "done")}
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    read = items.mapInArrow(counted, items.schema)
    reports.run_issue_reports(
        store, 1, read, spec, reports.Options(as_of="2020-02-01", idle_states=("done",)), (FlowReport("All", None, None),)
    )
    assert rows.value == 1  # items are made once for all reports
    for name in [name for name, _ in reports.ISSUE_RUN] + ["work_items_duration"]:
        assert spark.read.parquet(store.path(name)).count() > 0, name


def _counting(spark, table):
    """The table and a count of how many of its rows were read."""
    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    return table.mapInArrow(counted, table.schema), count


COMMITS = "createdAt timestamp_ntz, namespace string, project string, committer string, additions int, deletions int, total int, projectId int"


def _commits(spark):
    rows = [
        (datetime(2020, 1, 6, 9), "r / g", "r / g / p", "ann", 5, -1, 6, 1),
        (datetime(2020, 1, 6, 9), "r / g", "r / g / p", "ann", 5, -1, 6, 1),
        (datetime(2020, 1, 31, 23), "r / g", "r / g / p", "ann", 2, None, 2, 1),
        (datetime(2020, 2, 2, 1), "r / h", "r / h / q", "bob", None, None, None, 2),
        (datetime(2020, 2, 1, 1), None, None, None, 4, -4, 8, None),
        (datetime(2020, 3, 2, 1), "s / g", "s / g / p", "bob", 7, 0, 7, 3),
    ]
    return spark.createDataFrame(rows, COMMITS)


@pytest.mark.parametrize("run", [reports.COMMIT_RUN, (*reports.COMMIT_RUN, ("commits_summary", "MONTHS"), ("repos_activity_rank", "MONTHS"))])
def test_commit_run_reads_commits_once(spark, store, rows, run):
    projects = spark.createDataFrame([(1, ["api", "web"]), (2, ["api"]), (3, [])], "id int, tag_list array<string>")
    words = spark.createDataFrame([("api",), ("web",)], "value string")
    commits, count = _counting(spark, _commits(spark))
    inputs = reports.Tables(commits=commits, projects=projects, roles=words, categories=words)
    reports.run_reports(store, 1, run, inputs, reports.Options())
    assert count.value == 6
    plain = replace(inputs, commits=_commits(spark))
    for name in {name for name, _ in run}:
        tags = catalogue.tags_of(name)
        direct = [reports.report_points(name, plain, reports.Options(unit=unit)) for report, unit in run if report == name]
        columns = direct[0].columns
        assert rows(store.read(name, tags), *columns) == sorted((row for part in direct for row in rows(part)), key=repr), name


def test_commit_run_of_an_empty_table(spark, store):
    inputs = reports.Tables(commits=_commits(spark).where("false"))
    reports.run_reports(store, 1, (("commits_summary", "WEEKS"), ("committer_life_span", "MONTHS")), inputs, reports.Options())
    with pytest.raises(FileNotFoundError):
        store.read("commits_summary", catalogue.tags_of("commits_summary"))


def test_flow_run_normalizes_once(spark, store):
    statuses, count = _counting(spark, tables(spark).statuses)
    wanted = (FlowReport("all", unit="DAYS"), FlowReport("all", unit="WEEKS"))
    reports.run_flow_reports(store, 1, statuses, SPEC, wanted, ("count",))
    once, count.value = count.value, 0
    reports.run_flow_reports(store, 2, statuses, SPEC, wanted)
    # One aggregate alone normalizes for each bucket size; both together write the normalized items first.
    assert 0 < count.value <= once


def test_cached_averages(spark, tmp_path, rows):
    source = tmp_path / "issues"
    source.mkdir()
    history = [
        {"id": "1", "created": "2020-01-06T09:00:00.000+0000", "author": {"displayName": "a"}, "items": [{"fieldId": "status", "toStr": "In Progress"}]},
        {"id": "2", "created": "2020-01-08T09:00:00.000+0000", "author": {"displayName": "a"}, "items": [{"fieldId": "status", "toStr": "Done"}]},
    ]
    issue = {"key": "p-1", "fields": {"created": "2020-01-01T09:00:00.000+0000"}, "changelog": {"histories": history}}
    (source / "issues-p.json").write_text(json.dumps([issue]))
    settings = Settings({"p": SPEC.between("In Progress")}, {})
    asked = (spark, str(source), str(tmp_path / "cache"), settings, flow_request.FlowRequest("p", interval="day"))
    first = rows(flow_request.cached_averages(*asked))
    # On the first day the item is in work, two days later it leaves: cycle times 0, 0 and 1, work 1, 1 and 0.
    assert [round(value, 6) for value in first[0][1:]] == [0.333333, 0.666667]
    # The table and its averages, both kept under a key of their own.
    assert len(os.listdir(tmp_path / "cache")) == 2
    assert rows(flow_request.cached_averages(*asked)) == first
    assert flow_request.cached_flow(*asked).count() == 3
    assert len(os.listdir(tmp_path / "cache")) == 2


def test_a_load_is_dealt_once_and_only_wanted_fields_are_read(spark, store, rows):
    from flowgauge.sinks.metric_store import _newest_by_month

    points = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id) AS time, 'a' AS tag, id AS wanted, id AS other FROM range(90)")
    plan = _newest_by_month(points.withColumn("month", F.date_format("time", "yyyy-MM")), ("tag",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "month" in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
    for load_id in (1, 2):
        store.append(points.withColumn("wanted", F.col("wanted") + load_id).unionAll(points), "m", load_id, ("tag",))
    read = store.read("m", ("tag",)).select("time", "wanted")
    assert "other" not in read._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert [r.wanted for r in read.orderBy("time").collect()] == [at + 2 for at in range(90)]
    assert all(len(files) <= 16 for files in _files_by_month(store, "m"))


def _files_by_month(store, name):
    from pathlib import Path

    return [list(folder.glob("*.parquet")) for folder in Path(store.path(name)).glob("part=*/month=*")]


def test_commit_run_joins_each_vocabulary_once(spark, store, rows, monkeypatch):
    joined, taken = [], {}
    tag_rollup, builders = reports.commits.tag_rollup, dict(reports._BUILDERS)

    def counted(commits, tags, unit, tag):
        joined.append(tag)
        return tag_rollup(commits, tags, unit, tag)

    def noted(name):
        def build(tables, options):
            taken[name] = set(tables.commits.columns)
            return builders[name](tables, options)

        return build

    monkeypatch.setattr(reports.commits, "tag_rollup", counted)
    monkeypatch.setattr(reports, "_BUILDERS", {name: noted(name) for name in builders})
    projects = spark.createDataFrame([(1, ["api", "web"]), (2, ["api"]), (3, [])], "id int, tag_list array<string>")
    words = spark.createDataFrame([("api",), ("web",)], "value string")
    inputs = reports.Tables(commits=_commits(spark), projects=projects, roles=words, categories=words)
    reports.run_reports(store, 1, reports.COMMIT_RUN, inputs, reports.Options())
    assert joined == ["role", "category"]
    assert taken["commits_stats_by_project_role"] == {"createdAt", "namespace", "role", "additions", "deletions"}
    assert taken["committer_life_span_stats"] == {"committer", "firstAt", "lastAt"}
    assert "committer" not in taken["commits_summary"] and "committer" in taken["commits_stats"]


ITEMS = (
    "project string, id string, name string, type string, priority string, created timestamp_ntz, closed timestamp_ntz, "
    "createdBy string, size string, estimate double, "
    "statusHistory array<struct<created:timestamp_ntz,name:string,author:string,pos:bigint>>, epicName string, version int"
)
ISSUE_SPEC = {"a": FlowSpec({"new": -1, "todo": 0, "doing": 1, "done": 2}, "todo", "done")}


def _issue_items(spark, *entries):
    """Items of (id, type, history of (day, state))."""

    def history(changes):
        return None if changes is None else [(datetime(2020, 1, day, 9), state, "ann", at) for at, (day, state) in enumerate(changes)]

    rows = [("a", key, "n", kind, "High", datetime(2020, 1, 6), None, "ann", "S", 2.0, history(h), None, None) for key, kind, h in entries]
    return spark.createDataFrame(rows, ITEMS)


PLAIN_ISSUES = (
    ("1", "Bug", [(6, "todo"), (8, "done")]),
    ("2", "Bug", [(16, "doing"), (6, "todo"), (9, "new"), (9, "todo"), (20, "done")]),
    ("3", "Story", [(7, "todo"), (7, "doing")]),
    ("4", "Story", []),
    ("5", "Story", None),
    ("6", "Bug", [(7, "todo"), (8, "done"), (28, "done")]),
)
SHARED_IDS = (
    ("1", "Bug", [(7, "todo"), (9, "doing")]),
    ("2", "Story", [(30, "todo")]),
    (None, "Bug", [(6, "todo"), (13, "done")]),
    (None, "Bug", [(7, "todo")]),
)
ISSUE_OPTIONS = reports.Options(as_of="2020-02-01", idle_states=("done",), flow=ISSUE_SPEC)
ALL_ISSUES = (FlowReport("All", None, None, unit="DAYS"), FlowReport("Bugs", ("Bug",), None, unit="WEEKS"))


def test_issue_run_finds_stays_and_flows_within_the_row(spark, store, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("histories were taken apart and shuffled")

    monkeypatch.setattr(reports.cumulative, "normalize_statuses", refused)
    monkeypatch.setattr(reports.issues, "state_spans", refused)
    reports.run_issue_reports(store, 1, _issue_items(spark, *PLAIN_ISSUES), ISSUE_SPEC, ISSUE_OPTIONS, ALL_ISSUES)
    assert store.read("cfd_count", catalogue.FLOW_TAGS).count() > 0


@pytest.mark.parametrize("entries", [PLAIN_ISSUES, (*PLAIN_ISSUES, *SHARED_IDS)])
def test_issue_run_gives_the_points_of_flat_rows(spark, store, rows, entries):
    items = _issue_items(spark, *entries)
    reports.run_issue_reports(store, 1, items, ISSUE_SPEC, ISSUE_OPTIONS, ALL_ISSUES)
    flat = reports.Tables(statuses=reports.flatten(items), items=items)
    for name, unit in (*reports.ISSUE_RUN, ("work_items_duration", "WEEKS")):
        direct = reports.report_points(name, flat, replace(ISSUE_OPTIONS, unit=unit))
        assert rows(store.read(name, catalogue.tags_of(name)), *direct.columns) == rows(direct), name
    for aggregate in ("count", "estimate"):
        (direct,) = reports.flow_report_points(flat.statuses, ISSUE_SPEC, ALL_ISSUES, aggregate).values()
        assert rows(store.read(f"cfd_{aggregate}", catalogue.FLOW_TAGS), *direct.columns) == rows(direct), aggregate
