"""Every registered query against its SQL twin."""

import re

import __spark_entry__ as contract
import pytest
from compare import connect, differences
from workload import QUERIES

SF_DIR = "/root/testdata/sf0.001"

# Every identifier of the operator inventory.
INVENTORY = (
    [f"S{i}" for i in range(1, 18)]
    + [f"K{i}" for i in range(1, 8)]
    + [f"P{i}" for i in range(1, 16)]
    + [f"J{i}" for i in range(1, 6)]
    + [f"A{i}" for i in range(1, 12)]
    + [f"W{i}" for i in range(1, 3)]
    + [f"O{i}" for i in range(1, 5)]
    + [f"U{i}" for i in range(1, 7)]
    + [f"R{i}" for i in range(1, 4)]
    + [f"F{i}" for i in range(1, 16)]
    + ["T1"]
    + [f"Q{i}" for i in range(1, 11)]
)


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    query = QUERIES[name]
    result = query.run(spark, SF_DIR)
    if query.sql is None:
        assert result.count() >= 0
    else:
        assert differences(result, oracle, query.sql) == []


def test_all_operators_are_covered():
    covered = {code for query in QUERIES.values() for code in query.covers}
    assert sorted(set(INVENTORY) - covered) == []
    assert sorted(covered - set(INVENTORY)) == []


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0


def test_queries_use_whole_tables():
    for query in QUERIES.values():
        assert not re.search(r"\blimit\b|\bsample\b", query.sql or "", re.IGNORECASE)
