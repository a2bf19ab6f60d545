"""Corpus queries that SQL can express, against DuckDB on a whole small table."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare  # noqa: E402
from weftline.llm import registry  # noqa: E402

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, registry.queries()[name], ORACLES[name], "/root/testdata/sf0.01")


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
