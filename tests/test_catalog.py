"""Every query with SQL against DuckDB on the same tables."""

import pytest

from gridloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, same_rows):
    same_rows(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name])


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_sampling(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert 0 < catalog.QUERIES["sample_rows"](spark, sf_dir).count() < n
