import pytest
from compare import SF, check, connect

from sparkbrook import queries as stream


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(stream.queries()))
def test_query_equals_its_sql(spark, con, name):
    if name in stream.oracle_sql():
        check(spark, con, stream.queries()[name], stream.oracle_sql()[name])
    else:
        stream.queries()[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
