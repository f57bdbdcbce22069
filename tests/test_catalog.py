"""Every catalog query against its SQL in DuckDB."""

import os

import duckdb
import pytest
from conftest import SF, rounded

from helixframe import catalog_assay, catalog_functions, catalog_plans  # noqa: F401
from helixframe.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    expected = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert rounded(map(tuple, df.select(*[f"`{c}`" for c in cols]).collect())) == rounded(expected)
