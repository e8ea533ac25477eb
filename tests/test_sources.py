import json
from datetime import date, datetime

import pytest
from flowgauge.functions import names as N
from flowgauge.operators import work_items as W
from flowgauge.settings import FlowSpec, Settings, load_settings
from flowgauge.sources import increments, issues, repositories
from pyspark.sql import functions as F

CONFIG = {
    "gitlab": {"apiUrl": "", "token": ""},
    "jira": {
        "storyPointsField": "points",
        "estimateField": "size",
        "epicNameField": "epic",
        "projects": {
            "ABC": {
                "estimateMapping": {"S": 3, "L": 8},
                "referenceFlow": {"To Do": 1, "Done": 6},
                "entryState": "To Do",
                "finalState": "Done",
                "stateMapping": {"Invalid": "Done"},
                "prios": ["High", "Low"],
            }
        },
    },
    "data": {"location": "/data"},
    "reports": {"location": "/reports"},
    "emailMapping": {"a@b.example": "c@d.example"},
}
SETTINGS = load_settings(json.dumps(CONFIG))


def person(name):
    return {"accountId": name, "displayName": name}


def change(field, text, to=None):
    return {"fieldId": field, "toStr": text, "to": to}


def history(created, *items, author="ann"):
    return {"id": created, "author": person(author), "created": created, "items": list(items)}


def issue(key, *histories, resolved=None):
    return {
        "key": key,
        "fields": {
            "summary": f"about {key}",
            "resolutiondate": resolved,
            "created": "2020-01-01T23:30:00.000-0500",
            "issuetype": {"id": "1", "name": "Bug"},
            "reporter": person("rep"),
            "priority": {"name": "High"},
        },
        "changelog": {"histories": list(histories)},
    }


T1, T2, T3 = (f"2020-01-0{day}T10:00:00.000+0100" for day in (2, 3, 4))


def save(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(content))
    return str(folder)


def items_of(spark, tmp_path, *saved):
    path = save(tmp_path / "issues", "issues-ABC.json", list(saved))
    return issues.read_work_items(spark, path, SETTINGS)


def test_settings():
    assert SETTINGS.flows["ABC"].estimate_mapping == {"S": 3, "L": 8}
    assert SETTINGS.flows["ABC"].priorities == ("High", "Low")
    assert (SETTINGS.estimate_field, SETTINGS.data_location) == ("size", "/data")


def test_work_item(spark, tmp_path):
    saved = issue(
        "ABC-1",
        history(T2, change("size", "L"), change("status", "To Do"), change("epic", "E1"), change("fixVersions", "v7", "7")),
        history(T1, change("size", "S"), change("status", "Open", "1"), change(None, "x")),
        resolved="2020-01-05T00:10:00.000+0300",
    )
    row = items_of(spark, tmp_path, saved).first()
    assert (row["project"], row["id"], row["type"], row["priority"], row["createdBy"]) == ("ABC", "ABC-1", "Bug", "High", "rep")
    # The clock of the source is kept, its offset dropped.
    assert row["created"] == datetime(2020, 1, 1, 23, 30) and row["closed"] == datetime(2020, 1, 5, 0, 10)
    assert (row["size"], row["estimate"], row["epicName"], row["version"]) == ("L", 8.0, "E1", 7)
    assert [(s["created"].day, s["name"], s["author"]) for s in row["statusHistory"]] == [(3, "To Do", "ann"), (2, "Open", "ann")]


@pytest.mark.parametrize(
    "histories, size, estimate",
    [
        ([history(T1, change("size", "S"), change("points", "5"))], "S", 3.0),
        ([history(T1, change("size", "XXL"), change("points", "5"))], "XXL", 5.0),
        # The latest change has no value: earlier ones are not looked at.
        ([history(T1, change("size", "S"), change("points", "5")), history(T2, change("size", None))], None, 5.0),
        ([history(T1, change("points", ""))], None, 0.0),
        # Equal times: the later one in the document is the latest.
        ([history(T1, change("size", "S")), history(T1, change("size", "L"))], "L", 8.0),
        ([history(T3, change("size", "S")), history(T1, change("size", "L"))], "S", 3.0),
        ([], None, 0.0),
    ],
)
def test_latest_values(spark, tmp_path, histories, size, estimate):
    row = items_of(spark, tmp_path, issue("ABC-1", *histories)).first()
    assert (row["size"], row["estimate"]) == (size, estimate)


def test_version_that_is_no_number(spark, tmp_path):
    row = items_of(spark, tmp_path, issue("ABC-1", history(T1, change("fixVersions", "next", "next")))).first()
    assert row["version"] is None


def test_instants(spark, tmp_path):
    path = save(tmp_path / "issues", "issues-ABC.json", [issue("ABC-1")])
    row = issues.read_work_items(spark, path, SETTINGS, time_mode="instant").first()
    assert row["created"] == datetime(2020, 1, 2, 4, 30)


def test_flatten(spark, tmp_path, rows):
    items = items_of(spark, tmp_path, issue("ABC-1", history(T1, change("status", "To Do")), history(T2, change("status", "Done"))), issue("ABC-2"))
    flat = W.flatten(items)
    assert rows(flat, "project", "id", "statusName", "statusCreated") == [
        ("ABC", "ABC-1", "Done", datetime(2020, 1, 3, 10)),
        ("ABC", "ABC-1", "To Do", datetime(2020, 1, 2, 10)),
    ]
    truncated = W.truncate_times(flat.withColumn("closed", F.lit("2020-01-09 08:00:00").cast("timestamp_ntz")), "WEEKS")
    assert rows(truncated, "created", "closed", "statusCreated")[0] == (
        datetime(2019, 12, 30), datetime(2020, 1, 9, 8), datetime(2019, 12, 30),
    )


def test_trimming(spark, tmp_path):
    saved = issue("ABC-1", history(T1, change("size", "S"), change("status", "Open")), history(T2, change("size", "L")))
    path = save(tmp_path / "issues", "issues-ABC.json", [saved])
    read = issues.read_issues(spark, path)
    kept = W.trim_history_items(read).first()["changelog"]["histories"]
    assert [[item["fieldId"] for item in each["items"]] for each in kept] == [["status"]]
    all_kept = W.trim_history_items(read, keep=("status", "size")).first()["changelog"]["histories"]
    assert len(all_kept) == 2


def test_search_pages(spark, tmp_path):
    saved = issue("ABC-1", history(T1, change("status", "Open")))
    saved["changelog"]["histories"][0]["items"][0] = {"fieldId": "status", "toString": "Open"}
    pages = [{"startAt": 0, "maxResults": 2, "total": 2, "issues": [saved, issue("ABC-2")]}]
    path = save(tmp_path / "pages", "issues-ABC.json", pages)
    read = issues.read_issue_pages(spark, path)
    assert sorted(read.columns) == ["changelog", "fields", "key", "project"]
    items = issues.as_work_items(read, SETTINGS).orderBy("id").collect()
    assert [row["id"] for row in items] == ["ABC-1", "ABC-2"]
    assert items[0]["statusHistory"][0]["name"] == "Open"


def test_malformed_file_is_an_error(spark, tmp_path):
    (tmp_path / "issues-ABC.json").write_text("[{")
    with pytest.raises(Exception, match="(?i)malformed"):
        issues.read_issues(spark, str(tmp_path)).collect()


def test_project_without_sizes(spark, tmp_path):
    settings = Settings({"ABC": FlowSpec({"a": 0, "b": 1}, "a", "b")}, {}, "size", "points", None)
    path = save(tmp_path / "issues", "issues-ABC.json", [issue("ABC-1", history(T1, change("size", "S"), change("points", "2")))])
    row = issues.read_work_items(spark, path, settings).first()
    assert (row["estimate"], row["epicName"]) == (2.0, None)


def test_small_files(spark, tmp_path, rows):
    projects = save(tmp_path / "p", "projects.json", [{"id": 1, "name": "x", "name_with_namespace": "a / x", "tag_list": ["t"]}])
    assert rows(repositories.read_projects(spark, projects)) == [(1, "x", "a / x", ["t"])]
    spaces = save(tmp_path / "n", "namespaces.json", [{"id": "1", "name": "a", "path": "a", "full_path": "a"}])
    assert rows(repositories.read_namespaces(spark, spaces)) == [("1", "a", "a", "a", None)]
    versions = save(tmp_path / "v", "project-versions-ABC.json", [{"projectId": 1, "id": "2", "name": "v", "archived": False, "released": True, "startDate": "2020-01-05"}])
    row = issues.read_versions(spark, versions).first()
    assert (row["project"], row["startDate"], row["releaseDate"]) == ("ABC", date(2020, 1, 5), None)
    (tmp_path / "roles.txt").write_text("front\nback\n")
    assert rows(repositories.read_vocabulary(spark, str(tmp_path / "roles.txt"))) == [("back",), ("front",)]


def raw_commit(number, email, project=1, created="2020-01-01T01:00:00.000+0200"):
    return {"id": str(number), "created_at": created, "committer_email": email, "project_id": project, "stats": {"additions": 5, "deletions": 2, "total": 7}}


def lines(folder, *records):
    folder.mkdir(parents=True)
    (folder / "part.json").write_text("\n".join(json.dumps(record) for record in records))
    return str(folder)


def test_commits(spark, tmp_path, rows):
    path = lines(tmp_path / "c", raw_commit(1, "a@b.example"), raw_commit(2, "jenkins@x"), raw_commit(3, "A@b.example"), raw_commit(4, "z", 9))
    projects = spark.createDataFrame([(1, " x ", "top / sub / x")], "id int, name string, name_with_namespace string")
    cleaned = repositories.clean_commits(repositories.read_raw_commits(spark, path), SETTINGS.email_mapping)
    points = repositories.commit_points(cleaned, projects)
    when = datetime(2019, 12, 31, 23)
    assert rows(points) == [
        (when, "top / sub / x", "top / sub", "A@b.example", "1", 5, -2, 3, 7),
        (when, "top / sub / x", "top / sub", "c@d.example", "1", 5, -2, 3, 7),
    ]
    assert dict(repositories.commits_of(points).dtypes)["projectId"] == "int"
    table = spark.createDataFrame([("z", "zoe")], "email string, committer string")
    by_table = repositories.clean_commits(repositories.read_raw_commits(spark, path), table)
    assert rows(by_table, "committer_email") == [("A@b.example",), ("a@b.example",), ("zoe",)]


def test_commits_without_an_address_and_repeated_mappings(spark, rows):
    raw = spark.createDataFrame([("1", None), ("2", "z"), ("3", "jenkins@x")], "id string, committer_email string")
    table = spark.createDataFrame([("z", "zoe"), ("z", "abe")], "email string, committer string")
    assert rows(repositories.clean_commits(raw, table), "id", "committer_email") == [("1", None), ("2", "abe")]
    assert rows(repositories.clean_commits(raw, {}), "id") == [("1",), ("2",)]


def test_merge_requests(spark, tmp_path, rows):
    base = {
        "iid": 1, "state": "merged", "created_at": "2020-01-01T23:00:00.000-0500", "author": {"id": 1, "username": "ann"},
        "user_notes_count": 3, "project_id": 1, "source_branch": "f", "target_branch": "develop", "updated_at": "2020-01-03T00:00:00.000Z",
    }
    path = lines(tmp_path / "m", {**base, "id": 1, "merged_at": "2020-01-02T01:00:00.000-0500"}, {**base, "id": 2, "state": "opened"})
    points = repositories.merge_request_points(repositories.read_raw_merge_requests(spark, path), "2020-01-11 00:00:00")
    assert rows(points, "time", "id", "updated_at", "merged_at_ts", "duration_days") == [
        (datetime(2020, 1, 2, 4), "1", 1578009600000, 1577944800000, 1),
        (datetime(2020, 1, 2, 4), "2", 1578009600000, 0, 10),
    ]
    assert rows(repositories.merge_requests_of(points), "createdAt", "id", "mergedAt") == [
        (datetime(2020, 1, 2, 4), 1, datetime(2020, 1, 2, 6)),
        (datetime(2020, 1, 2, 4), 2, None),
    ]


def test_windows_of_the_next_load(spark):
    stored = spark.createDataFrame([(datetime(2020, 1, 1, 5),), (datetime(2020, 5, 1, 5),)], "time timestamp_ntz")
    empty = stored.where("false")
    as_of = "2021-01-01 00:00:00"
    assert increments.commit_window(stored, as_of) == (datetime(2020, 5, 1, 5), datetime(2021, 5, 1, 5))
    assert increments.merge_request_window(stored, as_of) == (datetime(2019, 5, 1, 5), datetime(2021, 5, 1, 5))
    assert increments.commit_window(empty, as_of) == (datetime(2011, 1, 1), datetime(2012, 1, 1))
    assert increments.within(stored, (datetime(2020, 5, 1, 5), datetime(2021, 5, 1, 5))).count() == 1


def test_names(spark):
    row = spark.range(1).select(
        N.parent_namespace(F.lit("x "), F.lit("a / b / x")).alias("parent"),
        N.root_namespace(F.lit(" a / b")).alias("root"),
        N.mapped_email(F.lit("A@B.example"), {"a@b.example": "c"}).alias("known"),
        N.mapped_email(F.lit("Z@B.example"), {"a@b.example": "c"}).alias("unknown"),
        N.contains_none_of(F.lit("a-b"), ("-",)).alias("wanted"),
    ).first()
    assert tuple(row) == ("a / b", "a", "c", "z@b.example", False)
