"""Every registered query against its DuckDB oracle on the small test data."""

import pytest

from ledgerlens.plans import ORACLE_SQL as ORACLE
from ledgerlens.plans import QUERIES
from oracle_compare import compare_one, duck_connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return duck_connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    ok, n, _, detail = compare_one(spark, duck, name, QUERIES[name], ORACLE[name], sf_dir)
    assert ok, detail
    assert "type differences" not in detail, detail


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["category", "total_transactions", "total_revenue", "avg_transaction",
                          "min_transaction", "max_transaction"]
    assert df.count() > 0
