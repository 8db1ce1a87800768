"""Queries that SQL can express, against it, on the whole tables of sf0.01."""

import pytest
from litspark.llm import queries

from ..oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])
