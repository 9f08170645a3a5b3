"""Every registered query with SQL gives DuckDB's rows."""

import pytest

from loomtext.plans import load_all
from loomtext.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, duck_rows, spark_rows

load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    cols, got = spark_rows(QUERIES[name](spark, sf))
    want_cols, want = duck_rows(con, ORACLES[name])
    assert cols == want_cols
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
