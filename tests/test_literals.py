"""Operators over literal rows give the rows written beside them."""

import duckdb
import pytest

from tests.compare import duck_rows, spark_rows
from tests.literals import CASES, corpora, details, extras, filters, knowledge, models, scalars, sequences  # noqa: F401


@pytest.mark.parametrize("name", sorted(CASES))
def test_literal(spark, name):
    run, want = CASES[name]
    assert spark_rows(run(spark, None)) == duck_rows(duckdb.connect(), want)
