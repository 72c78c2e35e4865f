"""Every registered query with SQL gives the same result in both engines, on whole tables."""

import pytest
from compare import compare, connection

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal(spark, con, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_names_match():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
