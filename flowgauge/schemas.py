"""Input schemas, as Spark DDL, and the column sets of the flat tables."""

from __future__ import annotations

_PERSON = "STRUCT<accountId: STRING, displayName: STRING>"


def _issue_fields(text_column: str) -> list[tuple[str, str]]:
    item = f"STRUCT<fieldId: STRING, `from`: STRING, fromString: STRING, `to`: STRING, {text_column}: STRING>"
    history = f"STRUCT<id: STRING, author: {_PERSON}, created: STRING, items: ARRAY<{item}>>"
    details = (
        "STRUCT<summary: STRING, resolutiondate: STRING, created: STRING, "
        f"issuetype: STRUCT<id: STRING, name: STRING>, reporter: {_PERSON}, priority: STRUCT<name: STRING>>"
    )
    return [("key", "STRING"), ("fields", details), ("changelog", f"STRUCT<histories: ARRAY<{history}>>")]


def issue_schema(text_column: str = "toStr") -> str:
    """One issue with its change log.

    Saved files name the new text of a change ``toStr``; tracker payloads name it
    ``toString``.
    """
    return ", ".join(f"{name} {kind}" for name, kind in _issue_fields(text_column))


def issue_page_schema(text_column: str = "toString") -> str:
    """One page of a search answer."""
    issue = ", ".join(f"{name}: {kind}" for name, kind in _issue_fields(text_column))
    return f"startAt INT, maxResults INT, total INT, issues ARRAY<STRUCT<{issue}>>"


VERSION = (
    "projectId INT, id STRING, name STRING, archived BOOLEAN, released BOOLEAN, startDate DATE, releaseDate DATE"
)

PROJECT = "id INT, name STRING, name_with_namespace STRING, tag_list ARRAY<STRING>"

NAMESPACE = "id STRING, name STRING, path STRING, full_path STRING, parent_id INT"

RAW_COMMIT = (
    "id STRING, short_id STRING, title STRING, message STRING, created_at STRING, committer_email STRING, "
    "stats STRUCT<additions: INT, deletions: INT, total: INT>, project_id INT"
)

RAW_MERGE_REQUEST = (
    "id INT, iid INT, state STRING, created_at STRING, author STRUCT<id: INT, username: STRING>, merged_at STRING, "
    "closed_at STRING, user_notes_count INT, project_id INT, source_branch STRING, target_branch STRING, updated_at STRING"
)

# Columns of one item; the flat table adds the three status columns and `pos`,
# the place of the change in its document, which orders changes of equal time.
ITEM_COLUMNS = (
    "id", "name", "type", "priority", "created", "closed", "createdBy", "size", "estimate", "epicName",
)
STATUS_COLUMNS = ("statusCreated", "statusName", "statusAuthor", "pos")

COMMIT_COLUMNS = (
    "createdAt", "project", "namespace", "committer", "additions", "deletions", "total", "effective", "projectId",
)
MERGE_REQUEST_COLUMNS = (
    "createdAt", "id", "projectId", "author", "state", "sourceBranch", "targetBranch", "userNotesCount", "mergedAt",
    "updatedAt",
)
