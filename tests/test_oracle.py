"""Every query against its DuckDB twin on the smallest tables; those without a twin must give rows."""

import pytest

from tessera.plans import catalog
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    if name in catalog.ORACLE_SQL:
        bad = compare(spark, con, sf, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
        assert bad is None, bad
    else:
        out = catalog.QUERIES[name](spark, sf)
        assert len(set(out.columns)) == len(out.columns)
        assert out.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
