"""Every query with an oracle against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(canon, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(map(canon, r))) for r in df.select(*cols).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert rows == sorted(repr(tuple(canon(r[i]) for i in order)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
