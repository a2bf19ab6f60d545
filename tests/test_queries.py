"""Every registered query runs; those with SQL give its rows."""

import pytest

from compare import compare
from weftline import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


#: Queries that have no rows, or none of a kind, on the smallest tables.
LARGER = ("customers_without_large_orders", "detection_rules", "directed_edges", "fresh_templates", "pmi_edges", "seeded_proposals")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    rows = compare(spark, name, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01" if name in LARGER else SF)
    assert rows or name not in LARGER


def test_queries_without_sql_have_values_tests():
    import os
    import re

    with open(os.path.join(os.path.dirname(__file__), "test_values.py")) as f:
        text = f.read()
    tests = re.split(r"\ndef test_", text)
    asserted = [n for n in sorted(set(QUERIES) - set(ORACLES)) if any(f'run("{n}")' in t and "assert" in t for t in tests)]
    assert asserted == sorted(set(QUERIES) - set(ORACLES))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
