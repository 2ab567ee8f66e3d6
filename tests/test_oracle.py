"""Every query of the library against its SQL in DuckDB."""

import pytest

from ledgerframe.queries import ORACLE_SQL, QUERIES

from .oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name])
