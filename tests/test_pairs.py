"""Queries on pairs over a table of many copies: the SQL's pairs, written in long runs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from peakloom.operators import relations as R
from peakloom.queries.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Sixty features of one time and two samples, around three masses one apart, a hundred times each with other ids."""
    folder = tmp_path_factory.mktemp("copies")
    duckdb.sql(f"""COPY (SELECT n * 60 + k AS o_orderkey, n * 7 AS o_custkey, 'F' AS o_orderstatus, 100000 + k % 3 * 1003 + k * 1.5e0 AS o_totalprice, TIMESTAMP '1996-01-01' + to_days(CAST(k AS INT)) AS o_orderdate, 's' || k % 2 AS o_orderpriority
        FROM range(60) a(k), range(100) b(n) ORDER BY n, k) TO '{folder}/orders.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name,widest", [("sc15_overlap_ratio", 0.6), ("sc16_isotope_steps", 0.5)])
def test_pairs_of_copies(spark, copies, tmp_path, name, widest):
    QUERIES[name](spark, copies).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{copies}/orders.parquet'; CREATE TABLE want AS {SQL[name]}")
    con.execute(f"CREATE TABLE found AS SELECT {', '.join(c[0] for c in con.execute('FROM want LIMIT 0').description)} FROM '{tmp_path}/out/*.parquet'")
    (n,), (m,) = con.execute("SELECT count(*) FROM want").fetchone(), con.execute("SELECT count(*) FROM found").fetchone()
    assert n == m > 1_000_000
    assert con.execute("SELECT count(*) FROM (FROM want EXCEPT ALL FROM found)").fetchone() == (0,)
    assert sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet")) / n < widest  # bytes a pair


def test_isotope_pairs_meet_in_cells_of_time_too(spark, copies):
    plan = QUERIES["sc16_isotope_steps"](spark, copies)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.split("\n") if "Join" in line)
    assert "__b0" in join and "__b1" in join and "lambda" not in plan


def test_steps_of_odd_differences(spark):
    steps = R.isotope_steps()
    halves = [(x + y) / 2 for x in steps for y in steps]
    deltas = [None, 0.0, -1.0, 0.98, 1.01, 1.02, 1.0200001, 2.0, 3.02, 4.03, 1e9, *steps, *halves, *(s + d for s in steps for d in (0.01, -0.01, 0.0100001))]
    df = spark.createDataFrame([(d,) for d in deltas], "d double").select("d", R.gap_class(F.col("d")).alias("gap"), R.nearest_step(F.col("d")).alias("step"))
    for d, gap, step in df.collect():
        away = None if d is None else [abs(d - s) for s in steps]
        whole = None if d is None else min(abs(d - n) for n in range(1, 5))
        assert (gap, step) == ((None, None) if d is None else ("classic" if min(away) <= 0.01 else "relaxed" if whole <= 0.02 else None, steps[away.index(min(away))]))
