"""Every workload query with SQL against DuckDB, at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck
from passbook.operators import models



#: Queries that fit hundreds of boosted trees; three trees each show here that they run, check.py grows all of them.
TREES = 3


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["accountId", "date", "balance", "running_date"]
    assert df.limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(oracle_sql())))
def test_query_equals_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, sf_dir)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(models, "TREES", TREES)
    assert queries()[name](spark, sf_dir).count() > 0
