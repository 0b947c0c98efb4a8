"""Every registered query of the engine against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__
from compare import check
from tessel import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_is_its_sql(spark, name):
    check(spark, queries.queries()[name], oracle.oracle_sql()[name])


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "query_id" and df.count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
