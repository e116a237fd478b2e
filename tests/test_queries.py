"""Every registered query against its SQL at the smallest scale."""

import pytest

from jobsieve.registry import load
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert status == "ok", note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLES)
