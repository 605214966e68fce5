"""Every query of the training-data operators with SQL against DuckDB on the same tables, value by value."""

import glob
import os

import duckdb
import pytest

from peakloom.llm.registry import QUERIES, SQL

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(SQL[name])
    names = sorted(d[0] for d in cursor.description)
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    want = sorted((tuple(r[at[n]] for n in names) for r in cursor.fetchall()), key=repr)
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == names
    found = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert len(found) == len(want) and [x for x in zip(found, want) if x[0] != x[1]][:3] == []
