"""Each query against the same statement in DuckDB."""

import pytest

from millrace.queries import ORACLES, QUERIES
from tests.oracle import DATA, of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    d = f"{DATA}/sf0.001"
    assert of_spark(QUERIES[name](spark, d)) == of_duckdb(ORACLES[name], d)
