"""Every query SQL can express agrees with its oracle on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, oracle_connection

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_oracle(spark, connection, name):
    problems, *_ = check(spark, connection, QUERIES[name], ORACLES[name], SF)
    assert not problems, problems


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 250
