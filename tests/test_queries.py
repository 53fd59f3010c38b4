"""Every query with SQL must give the same rows as DuckDB."""

import pytest
from oracle import compare

from epipanel.plans import queries as _queries  # noqa: F401
from epipanel.plans.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, small, name):
    message = compare(spark, duck, QUERIES[name], ORACLE[name], small)
    assert message is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
