import __spark_entry__
from tallgrass.plans import catalog


def test_entry_and_queries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.SQL) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())
