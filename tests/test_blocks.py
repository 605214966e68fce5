"""Scores of blocks of spectra against the kernels that take pairs one by one."""

import numpy as np
import pytest

from peakloom.kernels import blocks as B
from peakloom.kernels import similarity as K
from peakloom.operators import library as L


def side(rng, n, jitter, bad=False):
    spectra = []
    for _ in range(n):
        mz = 50 + 10.0 * np.flatnonzero(rng.random(12) < 0.7)
        mz = np.sort(np.r_[mz, mz[:1] + 0.01] if bad else mz) + rng.uniform(0, jitter)
        spectra.append((mz, rng.integers(1, 900, len(mz)).astype(float)))
    spectra[0] = (np.zeros(0), np.zeros(0))
    counts = np.array([len(m) for m, _ in spectra])
    return spectra, B.Side(100 + rng.integers(0, 2, n) / 100, counts, *(np.concatenate([s[k] for s in spectra]) for k in (0, 1)))


CASES = {
    "product": (lambda q, r: B.products(q, r, 0.02), lambda a, b, p, q: dict(zip(("total", "n_matched"), K.product(*a, *b, 0.02)))),
    "cosine": (lambda q, r: B.cosines(q, r, 0.02), lambda a, b, p, q: dict(zip(("score", "n_matched"), K.cosine(*a, *b, 0.02)))),
    "modified": (lambda q, r: B.modified_cosines(q, r, 0.02), lambda a, b, p, q: dict(zip(("score", "n_matched"), K.modified_cosine(*a, *b, p, q, 0.02)))),
    "loss": (lambda q, r: B.loss_cosines(q, r, 0.03, 20.0), lambda a, b, p, q: dict(zip(("score", "n_matched"), K.neutral_loss_cosine(*a, *b, p + 20, q + 20, 0.03)))),
    "composite": (lambda q, r: B.composites(q, r, 0.02), lambda a, b, p, q: K.composite(*a, *b, 0.02, p, q)),
}


@pytest.mark.parametrize("jitter", [0.0, 0.015])
@pytest.mark.parametrize("name", CASES)
def test_blocks_equal_pairs(name, jitter):
    rng = np.random.default_rng(7)
    (one, q), (two, r) = side(rng, 9, jitter), side(rng, 11, jitter)
    block, pair = CASES[name]
    found = block(q, r)
    assert found is not None
    for i, a in enumerate(one):
        for j, b in enumerate(two):
            want = pair(a, b, q.precursor[i], r.precursor[j])
            for k, v in want.items():
                assert found[k][i, j] == pytest.approx(v, abs=1e-9), (name, k, i, j)


def test_competing_peaks_are_left_to_the_pairs():
    rng = np.random.default_rng(8)
    (_, q), (_, r) = side(rng, 5, 0.0, bad=True), side(rng, 5, 0.0)
    assert B.products(q, r, 0.02) is None


def test_candidates_of_crowded_cells(spark):
    """Chunks of one cell and competing peaks give every pair once, as the pairs themselves do."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        mz = sorted(rng.choice(np.arange(50, 250, 10), 6, replace=False).tolist())
        mz = mz + [mz[-1] + 0.01] if k % 20 == 0 else mz
        rows.append((k, 100 + (k % 5) / 100, [(float(m), float(rng.integers(1, 99))) for m in mz]))
    df = spark.createDataFrame(rows, "spec_id long, precursor double, peaks array<struct<mz:double,intensity:double>>")
    for most in ((1024, 2048), (7, 9)):
        block = lambda q, r: B.cosines(q, r, 0.02)
        kernel = lambda ma, ia, mb, ib, p, q: dict(zip(("score", "n_matched"), K.cosine(ma, ia, mb, ib, 0.02)))
        got = L.score_candidates(df, df, 0.02, block, kernel, "n_matched long, score double", most).collect()
        found = {(r["query_id"], r["ref_id"]): (r["score"], r["n_matched"]) for r in got}
        assert len(found) == len(got)
        want = {}
        for a, p, x in rows:
            for b, q, y in rows:
                if a != b and abs(p - q) <= 0.02:
                    (ma, ia), (mb, ib) = (np.array(z).T for z in (x, y))
                    want[a, b] = K.cosine(ma, ia, mb, ib, 0.02)
        assert found.keys() == want.keys()
        assert all(found[k][0] == pytest.approx(v[0], abs=1e-9) and found[k][1] == v[1] for k, v in want.items())
