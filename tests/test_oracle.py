"""Every registered query with oracle SQL agrees with DuckDB at sf0.01."""

import pytest

from conftest import SF01
from oracle_compare import compare, duck
from threadlens.plans import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF01), con, ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_every_query_runs_on_smoke_data(spark):
    for name, fn in QUERIES.items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.limit(5).count() >= 0, name
