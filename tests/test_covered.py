"""Covered rows are found by shared ions and give what all pairs at their time give."""

import numpy as np

from peakloom.kernels.similarity import cosine
from peakloom.operators import alignment as A


def test_covered_rows_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"s{k % 2}", float(rng.integers(0, 40)) / 100, [(float(m) + float(rng.integers(0, 3)) / 100, float(rng.integers(1, 50))) for m in sorted(rng.choice(np.arange(100, 130), 4, replace=False))]) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, sample string, rt double, peaks array<struct<mz:double,intensity:double>>")
    out = A.covered_rows(df.where("id < 50"), df.where("id >= 50"), 0.05, 0.2)
    assert "rt_c" in out._jdf.queryExecution().optimizedPlan().toString() and "ion_c" in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r["id"]: (r["cover"], r["score"]) for r in out.collect()}
    want = {}
    for i, s, t, x in rows[:50]:
        scores = []
        for j, s2, t2, y in rows[50:]:
            if s == s2 and abs(t - t2) < 0.05:
                (ma, ia), (mb, ib) = (np.array(z).T for z in (x, y))
                scores.append((cosine(ma, ia, mb, ib, 0.02)[0], -j))
        if scores and max(scores)[0] >= 0.2:
            want[i] = (-max(scores)[1], max(scores)[0])
    assert found == want and want
