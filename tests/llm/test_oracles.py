"""Queries with SQL give DuckDB's rows."""

import pytest

from loomtext.llm import queries
from tests.compare import connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    got = spark_rows(queries.QUERIES[name](spark, sf))
    assert got == duck_rows(connect(sf), queries.ORACLES[name])
