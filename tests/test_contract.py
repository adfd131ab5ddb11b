"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# those of the training-data operators have tests of their own
OWN = [name for name in QUERIES if name not in contract.training_data_queries()]


def test_every_query_has_its_sql():
    assert set(OWN) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["id", "filename", "filetype", "content", "summary", "terms", "creation_ts"]
    assert rows.count() == 200
