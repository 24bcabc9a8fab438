"""Every registered query equals its DuckDB oracle on the sf0.001 tables."""

import pytest

from lookout.plans.catalog import load_all
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare

REG = load_all()


@pytest.mark.parametrize("name", sorted(n for n, e in REG.items() if e.sql))
def test_query_matches_oracle(spark, duck_small, name):
    res = compare(spark, duck_small, name, REG[name], SF_SMALL)
    assert res["ok"], res
