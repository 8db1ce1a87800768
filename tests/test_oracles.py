"""Every registered query of the library against its SQL, at sf0.01."""

import pytest
from litspark.plans import catalogue

from .oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    sql = catalogue.ORACLE_SQL.get(name)
    got = compare(df, con, sql) if sql else df.collect()
    assert got  # an empty answer proves nothing
