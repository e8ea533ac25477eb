"""Registered queries: same rows as the SQL, and plans that hold on large data."""

import re

import pytest
from checks import registry
from checks.compare import connect, difference

SMALL = "/root/testdata/sf0.001"

# Queries that put a landed JSON record together from its pieces: a group is one record, which has to be one row anyway.
PUT_TOGETHER = ("work_items_from_split_arrays",)


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, connection, name):
    assert difference(spark, connection, name, SMALL) is None


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_plan(spark, name):
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert costly not in plan, costly
    # Aggregates of objects may grow without bound, but for sketches: these have a fixed size and no other operator.
    for line in plan.splitlines():
        if "ObjectHashAggregate" in line:
            functions = re.findall(r"(\w+)\(", re.search(r"functions=\[(.*?)\], output", line)[1])
            if name in PUT_TOGETHER:
                continue
            assert all(re.fullmatch(r"(partial_|merge_)?hll_\w+", function) for function in functions), line


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert registry.queries().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
