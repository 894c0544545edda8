"""Every registered query against its SQL oracle."""

import pytest

import __spark_entry__ as E
from shopcat.plans.oracle import ORACLE
from shopcat.plans.queries import QUERIES
from tests.compare import oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
    assert set(QUERIES) - set(ORACLE) == {"page_main_text"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, name):
    columns, rows = spark_rows(spark, name, SF)
    want_columns, want = oracle_rows(name, SF)
    assert columns == want_columns
    assert rows == want


def test_entry(spark):
    assert E.entry(spark).columns == ["site", "type", "pages", "lowest", "highest"]
