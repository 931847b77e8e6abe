"""Every registered query of the panel engine against its DuckDB statement."""

from __future__ import annotations

import pytest

from tests.oracle import connect, oracle_rows, rows
from veldspar import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = rows(catalog.QUERIES[name](spark, sf))
    if name in catalog.ORACLES:
        assert got == oracle_rows(con, catalog.ORACLES[name])
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
