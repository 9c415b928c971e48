"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from tesserae.plans import registry

registry.load()
#: Reports of faults, which good data have none of, and thresholds that the smallest tables do not reach.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, data, con, name):
    columns, rows = rows_of(registry.QUERIES[name](spark, data))
    if name in registry.SQL:
        assert (columns, rows) == rows_of_sql(con, registry.SQL[name])
    assert columns and (rows or name in MAY_BE_EMPTY)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["AGG17"](spark, data).columns == ["guest", "pillars", "n", "names"]
