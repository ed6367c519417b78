"""Every query with an oracle, compared with DuckDB on the same tables."""

import pytest

import __spark_entry__ as spark_entry
import oracle

QUERIES = spark_entry.queries()
ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf_dir, duck, name):
    actual = QUERIES[name](spark, sf_dir).toArrow()
    assert oracle.differences(actual, oracle.expected(duck, ORACLES[name])) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
