"""Every core query with SQL gives the rows of that SQL; the others run and have a stable schema."""

import pytest

from palimpsest import catalog
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
SQL, QUERIES = catalog.oracle_sql(), catalog.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns
    df.collect()
