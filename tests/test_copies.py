"""Tables of many copies: joins tell equal rows once and give what all pairs would."""

import numpy as np
import pytest

from peakloom.kernels.align import reconcile
from peakloom.operators import extraction as X
from peakloom.operators import relations as R
from peakloom.plans import graph


def roots(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("seed", range(2))
def test_near_blocks_equal_all_pairs(spark, seed):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(seed)
    n = 260
    mz, rt = np.round(rng.uniform(0, 6, n), 2), np.round(rng.uniform(0, 6, n), 2)
    mz[200:], rt[200:] = mz[:60], rt[:60]
    sample = [f"s{k % 2}" for k in range(n)]
    df = spark.createDataFrame([(k, sample[k], float(mz[k]), float(rt[k])) for k in range(n)], "id long, sample string, mz double, rt double")
    found = {r["id"]: r["root"] for r in graph.near_blocks(df, F.col("id"), ["sample"], "mz", "rt", 0.25, 0.3, "root").collect()}
    pairs = [(a, b) for a in range(n) for b in range(a) if sample[a] == sample[b] and abs(mz[a] - mz[b]) <= 0.25 and abs(rt[a] - rt[b]) <= 0.3]
    assert found == dict(enumerate(roots(n, pairs)))


def test_isotope_links_have_the_components_of_the_edges(spark):
    rng = np.random.default_rng(3)
    base = [(float(m), float(t), float(h)) for m, t, h in zip(100 + rng.integers(0, 6, 30) * 1.003355, rng.uniform(0, 3, 30), rng.integers(1, 9, 30))]
    rows = [(k, "s", *base[k % 30]) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, sample string, mz double, rt double, height double")
    told = lambda edges: roots(90, [tuple(e) for e in edges.collect()])
    links, edges = R.isotope_links(df, 0.5), R.isotope_edges(df, 0.5).select("light", "heavy")
    assert told(links) == told(edges)
    assert links.count() < edges.count() / 3


def test_isotope_and_adduct_edges_need_no_shuffle_of_pairs(spark):
    df = spark.createDataFrame([(1, "s", 100.0, 1.0, 5.0), (2, "s", 101.0, 1.0, 4.0)], "id long, sample string, mz double, rt double, height double")
    for edges in (R.isotope_edges(df, 1.0), R.adduct_edges(df, 1.0)):
        assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_targets_of_equal_mass_are_windowed_once(spark):
    points = spark.createDataFrame([("a", s, 100.0 + s / 1000, float(s)) for s in range(1, 5) for _ in range(3)], "run string, scan int, mz double, intensity double")
    targets = spark.createDataFrame([(k, 100.0) for k in range(5)], "target_id long, target_mz double")
    got = sorted(map(tuple, X.sum_eic(points, targets, 0.02).collect()))
    assert got == sorted((k, "a", s, 3.0 * s) for k in range(5) for s in range(1, 5))


def test_reconcile_many_copies_is_quick():
    import time

    n = 6000
    begin = time.time()
    found = reconcile(np.full(n, 100.0), np.ones(n), np.ones(n), [frozenset("ab")] * n, 0.05, 0.3)
    assert len(np.unique(found)) == n and time.time() - begin < 20
