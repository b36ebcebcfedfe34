"""Queries against their SQL where both must state one rule: signs of zero, empty and null vectors, ends of a day."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def both(spark, folder, name, table):
    """Rows of a query and of its SQL over one small table, as text: that tells -0.0 from 0.0."""
    pq.write_table(pa.Table.from_pylist(table[1], table[2]), f"{folder}/{table[0]}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table[0]} AS SELECT * FROM '{folder}/{table[0]}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(folder)).select(*want.columns)
    return sorted(repr(tuple(r)) for r in got.collect()), sorted(map(repr, want.fetchall()))


VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])


def vectors(*given):
    return "embeddings", [{"vec_id": i, "embedding": v, "label": 0} for i, v in enumerate(given)], VECTORS


def test_l2_normalise(spark, tmp_path):
    got, want = both(spark, tmp_path, "m1_l2_normalise", vectors([-1e-9, 1.0] * 32, [0.0] * 64, None, [0.5, None] * 32, []))
    assert got == want
    assert "-0.0" not in want[0]


def test_mean_pool(spark, tmp_path):
    got, want = both(spark, tmp_path, "m3_mean_pool", vectors([-1e-9] * 64, [0.25] * 64, None, [0.5, None] * 32, [], [0.25] * 40))
    assert got == want
    assert "-0.0" not in want[0]


def test_rate_limit_ends_of_days(spark, tmp_path):
    """A request in the last half second of a day counts for that day, be it before 1970."""
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64())])
    rows = []
    for day in (dt.datetime(2024, 1, 2), dt.datetime(1969, 12, 30)):
        rows += [{"ts": day - dt.timedelta(milliseconds=300)}] + [{"ts": day + dt.timedelta(hours=h)} for h in range(5)]
    got, want = both(spark, tmp_path, "r3_rate_limit", ("events", [r | {"event_id": i, "user_id": 1} for i, r in enumerate(rows)], schema))
    assert got == want
    assert all("True" in r for r in want)
