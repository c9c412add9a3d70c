"""Every query of the subpackage that has SQL agrees with DuckDB on the smallest tables, columns and all."""

import duckdb
import pytest

from columnaut.llm import registry

from ..test_queries import SF, TABLES, cells


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, sql, name):
    want = sql.sql(registry.oracles()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert cells(got) == cells(want)
