"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from verdure import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if v is None or isinstance(v, (bool, int)):
        return v
    try:
        return float(f"{float(v):.9g}") if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
