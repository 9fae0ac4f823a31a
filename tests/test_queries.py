"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check_queries

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = check_queries.compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note
