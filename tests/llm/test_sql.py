"""Every query with SQL next to that SQL, at the smallest scale."""

import pytest

from jobsieve.llm.registry import load
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert status == "ok" and rows > 0, note
