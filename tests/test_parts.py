"""Parts of windows grow with the rows."""

from peakloom.operators.extraction import centroid_profile
from peakloom.plans.bands import spread_out


def parts(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return int(text.split("RepartitionByExpression")[1].split("], ")[1].split("\n")[0]) if "RepartitionByExpression" in text else None


def test_parts_grow_with_the_rows(spark):
    rows = lambda n: spark.range(n).selectExpr("id DIV 4 AS spec_id", "id * 1D AS mz", "1D AS intensity")
    small, large, larger = (parts(centroid_profile(rows(n), 1.0)) for n in (1000, 100_000_000, 200_000_000))
    assert small is None and large > 100 and larger >= 2 * large - 1


def test_no_row_is_lost(spark):
    rows = spark.range(1000).selectExpr("id DIV 4 AS spec_id", "id AS x")
    out = spread_out(rows, ["spec_id"], 100)
    assert parts(out) > 4 and sorted(r.x for r in out.collect()) == list(range(1000))
