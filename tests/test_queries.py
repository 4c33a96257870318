"""Every registered query on the smallest tables, against its SQL where it has one."""

import check
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.open_duckdb(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    assert len(ours) > 0
    if name in SQL:
        theirs = duck.execute(SQL[name]).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert check.rows(ours) == check.rows(theirs)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
