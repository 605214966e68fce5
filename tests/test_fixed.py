"""Numbers of records as C prints them."""

import random

from pyspark.sql import functions as F

from peakloom.operators.spectra import fixed


def test_fixed_rounds_the_binary_value(spark):
    random.seed(1)
    values = [0.0, 0.25, 0.35, 0.15, 12.25, 12.75, 0.05, 2.5, 3.5, 99.95, 1e12, 0.000005, 1.0000005, 123456.0000005, -0.25, -2.5, 1e300]
    values += [random.randrange(10**7) / 2000 for _ in range(2000)] + [random.randrange(5 * 10**7) / 100 / 1000 / 100 * 60 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[fixed(F.col("v"), p).alias(f"p{p}") for p in (0, 1, 5, 7)])
    wrong = [(r["v"], p, r[f"p{p}"]) for r in df.collect() for p in (0, 1, 5, 7) if abs(r["v"]) < 1e13 and r[f"p{p}"] != f"{r['v']:.{p}f}"]
    assert not wrong, wrong[:5]
