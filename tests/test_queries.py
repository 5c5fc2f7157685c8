"""Every registered query against its SQL on the smallest data folder."""

import pytest

from curbledger.plans.registry import REGISTRY
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_same_rows_as_sql(spark, db, name):
    ours, theirs, columns, their_columns, left, right = compare(spark, db, SMALL, name)
    assert columns == their_columns
    assert (left, right) == ([], [])
    assert ours == theirs


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
