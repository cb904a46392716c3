"""Every query with a SQL check gives the same rows as its check."""

import pytest
from compare import compare, connect
from conftest import SF_SMALL

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_check(spark, sf, duck, name):
    assert compare(queries()[name](spark, sf), duck, oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 4
    assert all(r.matches + r.under_predictions + r.over_predictions == r.total for r in rows)


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())
