"""All registered queries and their SQL."""

from __future__ import annotations

from checks import commit_checks, flow_checks, function_checks, issue_checks, merge_request_checks, source_checks, store_checks

MODULES = (
    flow_checks, issue_checks, commit_checks, merge_request_checks, source_checks, store_checks, function_checks,
)


def _merged(part: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        found = getattr(module, part)()
        repeated = merged.keys() & found.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        merged.update(found)
    return merged


def queries() -> dict:
    return _merged("queries")


def oracle_sql() -> dict:
    return _merged("oracle_sql")
