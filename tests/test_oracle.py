"""Every registered query that has SQL gives the rows of its SQL; every query gives rows."""

import pytest
from tests.conftest import rows_of

from tessera.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert got, "no rows"
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows_of(df.columns, got) == rows_of(rel.columns, rel.fetchall())


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
