"""The operators that SQL can express agree with DuckDB over whole tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conftest import SF01  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402

from threadlens.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    ok, message = compare(QUERIES[name](spark, SF01), duck(SF01), ORACLE[name])
    assert ok, f"{name}: {message}"
