"""Every registered query against its SQL, or for rows where SQL cannot say it."""

import pytest

from catalog import ORACLES, QUERIES
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, con, name):
    assert compare(QUERIES[name](spark, small), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).take(1)


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert "risk_score" in df.columns and df.count() > 0
