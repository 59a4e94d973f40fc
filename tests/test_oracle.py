"""Every query with SQL against DuckDB on the smallest tables, and every other query runs."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cuewright import catalog

SF = "/root/testdata/sf0.001"


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*cols).collect()), key=repr)
    if name not in catalog.oracle_sql():
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    rel = con.execute(catalog.oracle_sql()[name])
    assert sorted(d[0] for d in rel.description) == cols
    order = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want] or got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
