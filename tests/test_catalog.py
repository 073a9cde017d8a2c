"""Every query with SQL gives that SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from lorespark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rel = con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(_plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_rows_only_queries_give_rows(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() > 0, name
