"""Every registered query of the graph engine against its SQL."""

import pytest
from query_compare import same

from causeway.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert same(catalog.QUERIES[name](spark, sf), duck.sql(catalog.SQL[name]))


def test_entry(spark, duck):
    import __spark_entry__

    found = duck.sql(catalog.SQL["recall_turns"].replace("from conversations", "from '/root/testdata/sf0.001/conversations.parquet'"))
    assert same(__spark_entry__.entry(spark), found)


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
