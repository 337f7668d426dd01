"""Every registered query of the library against its DuckDB twin; queries without one are in test_brute."""

import parity
import pytest

from loomframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert parity.difference(df, con, catalog.ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
