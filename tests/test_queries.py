"""Every registered query of the reference's operators against its SQL, or its rows where it has none."""

import pytest
from oracle import compare

from loomgrade.plans import catalog

SF = "/root/testdata/sf0.01"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query = catalog.queries()[name]
    if name in SQL:
        assert compare(spark, SF, query, SQL[name])
    else:
        assert query(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
