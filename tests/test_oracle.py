"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings resolutions page_results chunks rankings qrels queries faculties programs".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = e.queries()[name](spark, SF)
    got = duck.execute(e.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(plain(x) for x in r) for r in df.collect()]) == rows(names, got.fetchall())
