"""Kernels against closed forms, brute force and synthetic curves."""

import itertools

import numpy as np
import pytest

from peakloom.kernels import align, clusters, deconvolution, peaks, similarity


def bell(rt, height, centre, width):
    return height * np.exp(-0.5 * ((rt - centre) / width) ** 2)


@pytest.fixture(scope="module")
def rt():
    return np.linspace(0, 15, 894)


def test_single_peak(rt):
    x = np.maximum(0, bell(rt, 5000, 5, 0.08) + np.random.default_rng(1).normal(0, 20, len(rt)))
    for found in (peaks.derivative_peaks(rt, x), peaks.builtin_peaks(rt, x)):
        assert len(found) == 1 and abs(rt[found[0]["apex"]] - 5) < 0.03 and found[0]["shape"] > 0.9 and found[0]["area"] > found[0]["height"]


def test_overlapping_peaks_and_noise(rt):
    rng = np.random.default_rng(2)
    two = np.maximum(0, bell(rt, 3000, 4, 0.08) + bell(rt, 2000, 4.5, 0.08) + rng.normal(0, 15, len(rt)))
    assert [round(float(rt[p["apex"]]), 1) for p in peaks.derivative_peaks(rt, two)] == [4.0, 4.5]
    noise = np.abs(rng.normal(0, 30, len(rt)))
    assert not peaks.derivative_peaks(rt, noise) and not peaks.builtin_peaks(rt, noise)
    assert not peaks.derivative_peaks(rt[:3], noise[:3]) and not peaks.derivative_peaks(rt, np.zeros(len(rt)))


def test_smoothing_ends():
    assert peaks.lwma(np.array([1.0, 5, 5, 5, 9]), 1)[0] == (3 * 1 + 5) / 4
    a, b, c, d = 1.0, 2.0, 4.0, 8.0
    y = peaks.lwma(np.array([a, b, c, d, 3, 3, 3]), 2)
    assert y[0] == pytest.approx((6 * a + 2 * b + c) / 9) and y[1] == pytest.approx((2 * a + 4 * b + 2 * c + d) / 9)
    line = np.arange(12.0)
    assert np.allclose(peaks.savitzky_golay(line**2, 5, 2), line**2) and np.allclose(peaks.gaussian_smooth(np.ones(9), 1.0), 1)
    assert np.allclose(peaks.five_points(line, peaks.FIRST)[2:-2], 1) and not peaks.five_points(line, peaks.FIRST)[:2].any()


def test_gap_fill(rt):
    x = bell(rt, 800, 5, 0.05)
    found = peaks.fill_gap(rt, x, 5.03, 0.2, 10.0)
    assert found["status"] == "filled" and not found["forced"] and abs(rt[found["apex"]] - 5) < 0.02
    assert peaks.fill_gap(rt, rt + 1, 9.0, 0.2, 10.0)["forced"] and peaks.fill_gap(rt, np.zeros(len(rt)), 9.0, 0.2, 10.0)["status"] == "no_signal"
    assert peaks.fill_gap(rt[:0], x[:0], 9.0, 0.2, 10.0)["status"] == "no_signal"


def brute_match(mz_a, a, mz_b, b, tolerance, shift):
    pairs = sorted(((-a[i] * b[j], i, j) for i in range(len(a)) for j in range(len(b)) if abs(mz_a[i] - mz_b[j] - shift) <= tolerance))
    left, right, out = set(), set(), []
    for _, i, j in pairs:
        if i not in left and j not in right:
            left.add(i), right.add(j), out.append((i, j))
    return out


def test_matching_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = rng.integers(0, 12, 2)
        mz_a, mz_b = rng.integers(0, 40, n) / 100 + 100, rng.integers(0, 40, m) / 100 + 100
        a, b = rng.integers(1, 5, n).astype(float), rng.integers(1, 5, m).astype(float)
        i, j = similarity.match(mz_a, a, mz_b, b, 0.03, 0.01)
        assert list(zip(i.tolist(), j.tolist())) == brute_match(mz_a, a, mz_b, b, 0.03, 0.01)


def test_scores_of_equal_and_strange_spectra():
    mz, x = np.array([100.0, 150, 200, 250, 300, 350]), np.array([10.0, 50, 100, 20, 5, 30])
    same = similarity.composite(mz, x, mz, x, 0.02)
    assert same["score"] == pytest.approx(2) and same["matched_pct"] == 1 and same["n_matched"] == 6
    assert similarity.composite(mz, x, mz + 7, x, 0.02)["score"] == 0 and similarity.composite(mz[:0], x[:0], mz, x, 0.02)["score"] == 0
    assert similarity.modified_cosine(mz, x, mz - 7, x, 400, 407, 0.02)[0] == pytest.approx(1)
    assert similarity.neutral_loss_cosine(mz, x, mz + 7, x, 400, 407, 0.02)[0] == pytest.approx(1)
    assert similarity.identity(mz[:2], x[:2], mz, x)[0] == "UNJUDGEABLE" and similarity.identity(mz, x, mz, x)[0] == "SAME" and similarity.identity(mz, x, mz + 7, x)[0] == "DIFFERENT"


def test_cleanup():
    mz, x, who = similarity.merge_close(np.array([100.0, 100.01, 100.05, 200.0]), np.array([1.0, 3.0, 3.0, 7.0]), 200)
    assert x.tolist() == [3.0, 7.0] and who.tolist() == [1, 3] and len(mz) == 2
    rng = np.random.default_rng(4)
    mz, x = rng.uniform(50, 900, 1000), rng.integers(1, 10**6, 1000).astype(float)
    mz, x = similarity.clean(mz, x, 500.0, most=100)
    assert len(mz) == 100 and (np.diff(mz) > 0).all() and mz.max() <= 501.5


def test_assignment():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n, m = map(int, rng.integers(1, 6, 2))
        edges = [sorted(set(rng.integers(0, m, rng.integers(0, m + 1)).tolist())) for _ in range(n)]
        best = max(sum(s is not None for s in p) for p in itertools.product(*[[None, *x] for x in edges]) if len({s for s in p if s is not None}) == sum(s is not None for s in p))
        found = clusters.full_matching(edges)
        assert len(found) == best and all(r in edges[left] for r, left in found.items()) and len(set(found.values())) == best
        cost = rng.random((n, m))
        total = sum(cost[i, j] for i, j in clusters.hungarian(cost))
        wide = cost if n <= m else cost.T
        assert total == pytest.approx(min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide))))


def test_alignment_keeps_every_feature_in_any_order():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = 25
        rank, mz, rt = rng.integers(0, 4, n), 100 + rng.integers(0, 12, n) / 200, rng.integers(0, 10, n) / 20
        height = rng.integers(1, 9, n).astype(float)
        ions = [np.array([50.0, 60, 70]) + 10 * k for k in rng.integers(0, 3, n)]
        heights = [np.array([3.0, 2, 1])] * n
        told = []
        for order in (np.arange(n), rng.permutation(n)):
            block = align.Block(rank[order], order, mz[order], rt[order], height[order], [ions[i] for i in order], heights)
            rows = block.align()
            assert sorted(int(block.id[i]) for i, *_ in rows) == list(range(n))
            seats = [(spot, int(block.rank[i])) for i, spot, status, _ in rows if status == "seated"]
            assert len(seats) == len(set(seats))
            assert all(block.identity(i, h)[0] == "SAME" for i, _, status, h in rows if status == "folded")
            told.append(sorted((int(block.id[i]), int(block.id[s]), status, int(block.id[h])) for i, s, status, h in rows))
        assert told[0] == told[1]


def test_isotopes_and_dedup():
    mz, rt, height = np.array([200.0, 201.0033, 202.0066, 200.0, 250.0]), np.array([5.0, 5, 5, 9, 5]), np.array([100.0, 20, 4, 50, 7])
    assert clusters.isotope_envelopes(mz, rt, height) == [(1, 0, 1), (2, 0, 2)]
    keep = clusters.proximity_dedup(np.array([100.0, 100.001, 100.002, 300]), np.zeros(4), np.array([1.0, 5, 2, 1]))
    assert keep.tolist() == [False, True, False, True]
    group = clusters.cluster_by_rt(np.array([1.0, 1.01, 1.2]), np.array([0.9, 0.9, 1.15]), np.array([1.1, 1.1, 1.3]), np.array([50.0, 50.001, 60]), np.array([1.0, 2, 3]))
    assert group.tolist() == [-1, 0, 1]


def test_factorisation():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 7):
        a = rng.normal(size=(n, n))
        f = deconvolution.factorise(a)
        assert np.allclose(deconvolution.inverse(f) @ a, np.eye(n)) and deconvolution.determinant(f) == pytest.approx(np.linalg.det(a))
    assert deconvolution.factorise(np.array([[0.0, 0], [1, 1]])) is None
    assert deconvolution.factorise(np.ones((2, 2))) is not None  # a zero pivot is lifted


def test_separation_of_two_compounds():
    scans = np.arange(120.0)
    one, two = bell(scans, 1.0, 50, 4), bell(scans, 1.0, 62, 4)
    mz = np.array([80.0, 90, 100, 110])
    traces = np.array([9000 * one, 6000 * one + 3000 * two, 8000 * two, 4000 * two])
    found_mz, found = deconvolution.separate(mz, traces, 50)
    share = dict(zip(found_mz.tolist(), found.tolist()))
    assert share[80.0] == pytest.approx(9000, rel=0.1) and share[90.0] == pytest.approx(6000, rel=0.15) and share.get(100.0, 0) < 800
    assert not len(deconvolution.separate(mz, traces, 20)[0]) and not len(deconvolution.separate(mz[:0], traces[:0], 20)[0])


def test_components():
    scans = np.arange(120.0)
    one, two = bell(scans, 1.0, 40, 3), bell(scans, 1.0, 70, 3)
    traces = np.array([9000 * one, 5000 * one, 8000 * two, 4000 * two + 100 * one])
    found = deconvolution.extract_components(np.array([80.0, 90, 100, 110]), traces, noise=1.0)
    assert [round(c["scan"]) for c in found] == [40, 70]
    assert {m for m, s, _ in found[0]["peaks"] if s > 1000} == {80.0, 90.0} and {m for m, s, _ in found[1]["peaks"] if s > 1000} == {100.0, 110.0}
    noisy = np.random.default_rng(8).normal(100, 10, (20, 500))
    assert deconvolution.noise_factor(noisy) == pytest.approx(0.6745, rel=0.2)
