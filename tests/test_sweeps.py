"""Sweeps over sorted rows against the kernels that see a whole group, on rows in pieces."""

import time

import numpy as np
import pytest

from peakloom.kernels import clusters, ions, sweeps


def swept(group, rows, seed=0):
    """Results of a sweep that is fed pieces of any size."""
    n, begin, out, rng = len(next(iter(rows.values()))), 0, [], np.random.default_rng(seed)
    while begin < n:
        end = begin + int(rng.integers(1, 40))
        out.append(group.feed(**{c: v[begin:end] for c, v in rows.items()}))
        begin = end
    out = [o for o in [*out, group.finish()] if o is not None]
    return {c: np.concatenate([np.asarray(o[c]) for o in out if len(o[c])]) if any(len(o[c]) for o in out) else np.zeros(0) for c in out[0]} if out else {}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(6))
def test_assignment_equals_best_first_over_all_pairs(seed, monkeypatch):
    monkeypatch.setattr(sweeps, "PAIRS", 50)
    rng = np.random.default_rng(seed)
    n = 120
    rt = np.sort(rng.integers(0, 300 if seed % 2 else 40, n) / 100)  # dense ones have many equal rows
    rows = {"side": rng.integers(0, 2, n), "id": rng.permutation(n), "rt": rt, "left": rt - rng.integers(0, 4, n) / 50, "right": rt + rng.integers(0, 3, n) / 50}
    if seed == 5:
        rows["id"] = rows["id"] // 2  # ids that come twice
    one, two = (np.flatnonzero(rows["side"] == k) for k in (0, 1))
    pairs = []
    for i in one:
        for j in two:
            if abs(rt[i] - rt[j]) <= 0.1:
                shared = max(0.0, min(rows["right"][i], rows["right"][j]) - max(rows["left"][i], rows["left"][j]))
                narrow = min(rows["right"][i] - rows["left"][i], rows["right"][j] - rows["left"][j])
                score = 0.7 * (1 - abs(rt[i] - rt[j]) / 0.1) + 0.3 * (min(1.0, shared / narrow) if narrow > 0 else 0.0)
                pairs.append((round(score, 9), int(rows["id"][i]), int(rows["id"][j])))
    pairs.sort(key=lambda p: p[1:])
    score, left, right = (np.array(x) for x in zip(*pairs))
    want = {pairs[k][1:] for k in clusters.exclusive_pairs(score, left, right).tolist()}
    found = swept(sweeps.Assignment(0.1, 0.3), rows, seed)
    assert set(zip(found["id"].tolist(), found["peak"].tolist())) == want and len(found["id"]) == len(want)


def test_assignment_of_many_copies_holds_no_pairs(spark):
    from peakloom.operators.alignment import exclusive_assignment

    side = lambda shift: spark.range(3000).selectExpr("'s' AS sample", "1L AS channel", f"id + {shift} AS id", "1D AS rt", "0.9D AS left", "1.1D AS right")
    out = exclusive_assignment(side(0), side(10_000), 0.1)
    assert "Join" not in plan(out)  # 9 million pairs were written and their components found
    assert sorted((r.id, r.peak) for r in out.collect()) == [(i, 10_000 + i) for i in range(3000)]


def test_scores_round_as_spark_does(spark):
    from pyspark.sql import functions as F

    values = [0.1234567885, 0.0000000005, 0.25, 0.7 * 0.3, 0.5000000015, 0.0000000025, 1 / 3]
    want = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9).alias("x")).collect()]
    assert (sweeps.billionths(np.array(values)) / 1e9).tolist() == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_merged_regions(seed, monkeypatch):
    monkeypatch.setattr(sweeps, "PAIRS", 300)
    monkeypatch.setattr(sweeps.Survivors, "BLOCK", 64)
    rng = np.random.default_rng(seed)
    n = 400
    mz = np.sort(rng.integers(0, 100, n) / 50)
    apex, half = rng.uniform(0, 3, n), rng.integers(0, 7, n) / 20
    rows = {"id": np.arange(n), "mz": mz, "left": apex - half, "right": apex + half, "apex": apex, "height": rng.integers(0, 50, n).astype(float)}
    want = np.flatnonzero(ions.merge_regions(mz, rows["left"], rows["right"], apex, rows["height"], 0.2))
    assert sorted(swept(sweeps.MergedRegions(0.2), rows, seed)["id"].tolist()) == want.tolist() and len(want) < n


def test_regions_meet_without_pairs(spark):
    from peakloom.operators.separation import merge_regions

    rows = spark.range(5000).selectExpr("'s' AS sample", "id", "100D AS mz", "0.9D AS left", "1.1D AS right", "1D AS apex", "double(id) AS height")
    out = merge_regions(rows, ["sample"], 0.2)
    assert "Join" not in plan(out)  # 12 million pairs linked them before
    assert [r.id for r in out.collect()] == [4999]


@pytest.mark.parametrize("seed", range(6))
def test_envelopes(seed):
    rng = np.random.default_rng(seed)
    n = 500
    mz = np.sort(np.round((900 if seed == 5 else 100) + rng.integers(0, 12, n) * clusters.CARBON / rng.integers(1, 5, n) + rng.integers(0, 3, n) * 0.004, 6))
    rows = {"id": np.arange(n) + 7, "mz": mz, "rt": rng.integers(0, 40, n) / 100, "height": rng.integers(-1, 1000, n).astype(float)}
    want = {(int(rows["id"][i]), int(rows["id"][m]), s) for i, m, s in clusters.isotope_envelopes(mz, rows["rt"], rows["height"], 0.005, 0.05)}
    found = swept(sweeps.EnvelopeWalk(0.005, 0.05), rows, seed)
    assert set(zip(*(found[c].tolist() for c in ("id", "mono", "step")))) == want and want


def test_envelope_rows_that_are_gone():
    """Far more rows than a walk reaches."""
    rng = np.random.default_rng(9)
    mz = np.sort(np.round(rng.uniform(100, 700, 50_000), 4))
    rt, height = rng.integers(0, 200, len(mz)) / 100, rng.uniform(1, 9, len(mz))
    group = sweeps.EnvelopeWalk(0.005, 0.05)
    found = [f for k in range(0, len(mz), 5000) if (f := group.feed(np.arange(k, k + 5000), mz[k : k + 5000], rt[k : k + 5000], height[k : k + 5000]))]
    assert len(group.mz) < len(mz) / 2
    found += [f] if (f := group.finish()) else []
    want = clusters.isotope_envelopes(mz, rt, height, 0.005, 0.05)
    assert {t for f in found for t in zip(f["id"], f["mono"], f["step"])} == set(want)


def test_envelopes_meet_without_pairs(spark):
    from peakloom.operators.kernelled import isotope_envelopes

    rows = spark.range(6).selectExpr("'s' AS sample", "id", "100 + id * 1.003355D AS mz", "1D AS rt", "double(10 - id) AS height")
    out = isotope_envelopes(rows)
    assert "Join" not in plan(out)
    assert sorted((r.id, r.mono, r.step) for r in out.collect()) == [(i, 0, i) for i in range(1, 6)]


@pytest.mark.parametrize("seed", range(6))
def test_slice_twins(seed, monkeypatch):
    monkeypatch.setattr(sweeps, "PAIRS", 40)
    rng = np.random.default_rng(seed)
    n = 500
    apex, half = rng.integers(0, 300, n) / 100, rng.integers(0, 7, n) / 20
    place = np.lexsort((np.arange(n), apex, slices := np.sort(rng.integers(0, 30, n))))
    rows = {"id": np.arange(n), "slice": slices, "mz": slices / 10 + rng.uniform(0, 0.1, n), "left": apex - half, "right": apex + half, "apex": apex, "height": rng.integers(0, 90, n).astype(float)}
    rows = {c: v[place] for c, v in rows.items()}
    keep = ions.slice_redundancy(*(rows[c] for c in ("slice", "mz", "apex", "left", "right", "height")), 0.2, 1.0)
    found = swept(sweeps.SliceTwins(0.2, 1.0), rows, seed)["id"].tolist()
    assert sorted(found) == sorted(rows["id"][keep].tolist()) and len(found) < n


def test_slice_twins_of_large_slices():
    n = 6000
    apex = np.sort(np.random.default_rng(1).uniform(0, 24, 2 * n).reshape(2, n), axis=1).reshape(-1)
    rows = {"id": np.arange(2 * n), "slice": np.repeat([0, 1], n), "mz": np.full(2 * n, 5.0), "left": apex - 0.001, "right": apex + 0.001, "apex": apex, "height": np.ones(2 * n)}
    begin = time.monotonic()
    group = sweeps.SliceTwins(0.2, 1.0)
    group.feed(**rows)
    found = group.finish()
    assert len(found["id"]) < 2 * n and time.monotonic() - begin < 5  # 36 million pairs one by one before


@pytest.mark.parametrize("seed", range(4))
def test_running_mean_bins(seed):
    from peakloom.kernels.bins import binned_maxima, running_mean_bins

    rng = np.random.default_rng(seed)
    n = 600
    rows = {"mz": rng.uniform(100, 103, n), "scan": rng.integers(0, 12, n), "intensity": rng.integers(0, 30, n).astype(float)}
    order = np.lexsort((rows["intensity"], rows["scan"], rows["mz"]))
    mz, scan, intensity = (v[order] for v in rows.values())
    bins = running_mean_bins(mz[intensity >= 10], intensity[intensity >= 10], 0.02)
    place, at, value = binned_maxima(bins, mz, scan, intensity, 0.02)
    place, at, value = place[value > 0], at[value > 0], value[value > 0]
    enough = np.bincount(place, minlength=len(bins)) >= 3
    want = {(bins[p], s, v) for p, s, v in zip(place.tolist(), at.tolist(), value.tolist()) if enough[p]}
    group = sweeps.RunningMean(0.02, 10.0, 3, 100.0)
    found = swept(group, {"mz": mz, "scan": scan, "intensity": intensity, "channel_mz": np.full(n, 100.0)}, seed)
    assert set(zip(*(found[c].tolist() for c in ("mz", "scan", "intensity")))) == want and want


def test_running_mean_holds_the_open_bins_only():
    group = sweeps.RunningMean(0.02, 10.0, 3, 100.0)
    for k in range(200):
        group.feed(np.full(1000, 100 + k * 0.1), np.arange(1000), np.full(1000, 20.0), np.full(1000, 100.0))
        assert sum(len(x["mz"]) for x in group.wait) + sum(len(x["bin"]) for x in group.met) <= 5000


def test_groups_reach_python_row_by_row(spark):
    from peakloom.operators.kernelled import map_groups

    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 < 2 THEN id % 3 END AS k", "CASE WHEN id % 5 > 0 THEN 'x' END AS n", "id")
    out = map_groups(rows, ["k", "n"], ["id"], ["id"], lambda id: [{"first": int(id[0]), "size": len(id)}], "first long, size long")
    assert "collect_list" not in plan(out)  # a group was one row of the JVM, and a batch of groups one table of Python
    found = {(r.k, r.n): (r.first, r.size) for r in out.collect()}
    assert found == {(0, None): (0, 2000), (1, None): (10, 2000), (None, None): (5, 2000), (0, "x"): (3, 8000), (1, "x"): (1, 8000), (None, "x"): (2, 8000)}


def naive_groups(values, tolerance):
    out, begin = np.zeros(len(values), np.int64), 0
    for i in range(1, len(values)):
        if values[i] - np.median(values[begin:i]) > tolerance:
            begin = i
            out[i:] += 1
    return out


def test_running_medians_of_many_equal_times():
    rng = np.random.default_rng(3)
    for values in (np.sort(rng.uniform(0, 5, 300)), np.sort(rng.integers(0, 50, 300) / 10), np.array([np.nan, 1.0, 9.0]), np.array([1.0, 9.0, np.nan, np.nan])):
        assert clusters.running_median_groups(values, 0.3).tolist() == naive_groups(values, 0.3).tolist()
    begin = time.monotonic()
    assert not clusters.running_median_groups(np.ones(100_000), 0.1).any()
    assert time.monotonic() - begin < 5


def test_clusters_of_many_equal_times():
    n = 20_000
    begin = time.monotonic()
    found = clusters.cluster_by_rt(np.ones(n), np.zeros(n), np.full(n, 2.0), np.arange(n) / 10, np.ones(n))
    assert not found.any() and time.monotonic() - begin < 5


def test_clusters_of_missing_bounds():
    at = np.array([1.0, 1.01, 1.03, 1.2, np.nan])
    lost = np.array([np.nan, 1.0, 1.0, 1.0, 1.0])
    assert clusters.cluster_by_rt(at, lost, at + 0.01, np.arange(5.0), np.ones(5)).tolist() == [0, 0, 1, 2, 3]
