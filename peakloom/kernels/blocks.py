"""Scores of all pairs between two sets of spectra as matrix products.

Where m/z fall into islands that hold at most one peak of a spectrum, all of whose pairs are within the tolerance and none of which
is within it of another island, the 1:1 matching is known without a search: two spectra match where both have a peak. Sums over
matches are then products of matrices with a row a spectrum and a column an island. Each function returns a matrix a score, or None
where the islands do not allow it; the kernels of ``similarity`` then take the pairs one by one.
"""

from __future__ import annotations

import numpy as np

from peakloom.kernels.similarity import PENALTY, TINY

CELLS = 20_000_000


class Side:
    """Spectra as flat arrays: ``owner`` is the row of each peak."""

    def __init__(self, precursor: np.ndarray, counts: np.ndarray, mz: np.ndarray, intensity: np.ndarray) -> None:
        self.precursor, self.counts, self.mz, self.intensity = precursor, counts, mz, intensity
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.ends = np.cumsum(counts)

    def take(self, rows: np.ndarray) -> Side:
        held = self.counts[rows]
        at = np.repeat(self.ends[rows] - held, held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        return Side(self.precursor[rows], held, self.mz[at], self.intensity[at])

    def only(self, keep: np.ndarray, mz: np.ndarray | None = None) -> Side:
        """The peaks of ``keep``, at other m/z if given."""
        return Side(self.precursor, np.bincount(self.owner[keep], minlength=len(self.counts)), (self.mz if mz is None else mz)[keep], self.intensity[keep])

    def spectrum(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        begin, end = self.ends[i] - self.counts[i], self.ends[i]
        return self.mz[begin:end], self.intensity[begin:end]

    def total(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights, len(self.counts))

    def top(self) -> np.ndarray:
        out = np.zeros(len(self.counts))
        np.maximum.at(out, self.owner, self.intensity)
        return out


def islands(q: Side, r: Side, tolerance: float, shift: float = 0.0):
    """Functions that lay peak values out by island, one a side, or None; islands are further apart than ``tolerance`` and ``shift``."""
    every = np.r_[q.mz, r.mz]
    if not len(every) or not np.isfinite(every).all():
        return None
    values, place = np.unique(every, return_inverse=True)
    island = np.r_[0, np.cumsum(np.diff(values) > (tolerance + shift) * (1 + 1e-9) + (1e-9 if tolerance else 0.0))][place.reshape(-1)]
    n = int(island.max()) + 1
    if max(len(q.counts), len(r.counts)) * n > CELLS:
        return None
    mine = (island[: len(q.mz)], island[len(q.mz) :])
    low, high = np.full((2, n), np.inf), np.full((2, n), -np.inf)
    for k, s in enumerate((q, r)):
        at = s.owner * n + mine[k]
        if len(np.unique(at)) < len(at):
            return None
        np.minimum.at(low[k], mine[k], s.mz)
        np.maximum.at(high[k], mine[k], s.mz)
    both = np.isfinite(low).all(0)
    if (high[0][both] - low[1][both] > tolerance).any() or (high[1][both] - low[0][both] > tolerance).any():
        return None

    def lay(side: Side, where: np.ndarray):
        def out(weights) -> np.ndarray:
            m = np.zeros((len(side.counts), n))
            m[side.owner, where] = weights
            return m

        return out

    return lay(q, mine[0]), lay(r, mine[1])


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x).astype(np.int64)


def products(q: Side, r: Side, tolerance: float) -> dict | None:
    laid = islands(q, r, tolerance)
    if laid is None:
        return None
    a, b = laid
    return {"total": a(q.intensity) @ b(r.intensity).T, "n_matched": _whole(a(1.0) @ b(1.0).T)}


def _cosine(q: Side, r: Side, found: dict) -> np.ndarray:
    x, y = np.sqrt(q.total(q.intensity**2))[:, None], np.sqrt(r.total(r.intensity**2))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((x >= TINY) & (y >= TINY), np.minimum(found["total"] / (x * y), 1.0), 0.0)


def cosines(q: Side, r: Side, tolerance: float) -> dict | None:
    found = products(q, r, tolerance)
    if found is None:
        return None
    alive = (q.total(q.intensity) > 0)[:, None] & (r.total(r.intensity) > 0)[None, :]
    return {"score": _cosine(q, r, found), "n_matched": np.where(alive, found["n_matched"], 0)}


def modified_cosines(q: Side, r: Side, tolerance: float, exclusion: float = 1.5) -> dict | None:
    """Islands are so far apart that the shifted frame matches no more than the direct one."""
    q, r = (s.only(np.abs(s.mz - s.precursor[s.owner]) > exclusion) for s in (q, r))
    laid = islands(q, r, tolerance, _shift(q, r))
    if laid is None:
        return None
    a, b = laid
    found = {"total": a(q.intensity) @ b(r.intensity).T, "n_matched": _whole(a(1.0) @ b(1.0).T)}
    alive = (q.total(q.intensity != 0) > 0)[:, None] & (r.total(r.intensity != 0) > 0)[None, :]
    return {"score": np.where(alive, _cosine(q, r, found), 0.0), "n_matched": np.where(alive, found["n_matched"], 0)}


def loss_cosines(q: Side, r: Side, tolerance: float, above: float = 0.0) -> dict | None:
    """Cosines of the losses from the precursors and ``above``."""
    losses = []
    for s in (q, r):
        loss = (s.precursor + above)[s.owner] - s.mz
        losses.append(s.only(loss > 0, loss))
    return cosines(*losses, tolerance)


def _shift(q: Side, r: Side) -> float:
    return max(abs(q.precursor.max() - r.precursor.min()), abs(r.precursor.max() - q.precursor.min()))


def composites(q: Side, r: Side, tolerance: float, shifted: bool = True) -> dict | None:
    """As ``similarity.composite``; islands are so far apart that the shifted frame matches no more than the direct one."""
    laid = islands(q, r, tolerance, _shift(q, r) if shifted else 0.0)
    if laid is None or (q.intensity < 0).any() or (r.intensity < 0).any():
        return None
    a, b = laid
    top_q, top_r = q.top(), r.top()
    with np.errstate(divide="ignore", invalid="ignore"):
        share_q, share_r = q.intensity / top_q[q.owner], r.intensity / top_r[r.owner]
        here_q, here_r, root_q, root_r = a(1.0), b(1.0), np.sqrt(share_q), np.sqrt(share_r)
        n = _whole(here_q @ here_r.T)
        mass_q = (a(share_q * q.mz) @ here_r.T + a(share_q) @ b(r.mz).T) / 2
        mass_r = (here_q @ b(share_r * r.mz).T + a(q.mz) @ b(share_r).T) / 2
        all_q = mass_q + np.maximum(q.total(share_q * q.mz)[:, None] - a(share_q * q.mz) @ here_r.T, 0.0)
        all_r = mass_r + np.maximum(r.total(share_r * r.mz)[None, :] - here_q @ b(share_r * r.mz).T, 0.0)
        weighted = ((a(root_q * q.mz) @ b(root_r).T + a(root_q) @ b(root_r * r.mz).T) / 2) ** 2
        plain = (a(root_q) @ b(root_r).T) ** 2
        penalty = np.array([PENALTY.get(k, 1.0) for k in r.counts.tolist()])[None, :]
        dot = lambda top, x, y: np.where((x > TINY) & (y > TINY), np.minimum(top / (x * y) * penalty, 1.0), 0.0)
        wdp, sdp, rdp = dot(weighted, all_q, all_r), dot(plain, q.total(share_q)[:, None], r.total(share_r)[None, :]), dot(weighted, mass_q, all_r)
        strong = (r.intensity >= top_r[r.owner] * 0.01).astype(float)
        matched = here_q @ b(strong).T / np.maximum(r.total(strong), 1)[None, :]
    out = {"score": (np.sqrt(wdp) + np.sqrt(sdp) + np.sqrt(rdp)) / 3 + matched, "n_matched": n, "wdp": wdp, "sdp": sdp, "rdp": rdp, "matched_pct": matched}
    alive = (top_q >= TINY)[:, None] & (top_r >= TINY)[None, :]
    return {k: np.where(alive, v, 0) for k, v in out.items()}


def match_factors(q: Side, r: Side, tolerance: float, penalty: float) -> dict | None:
    c = composites(q, r, tolerance, shifted=False)
    if c is None:
        return None
    factor = (3 * c["wdp"] + 3 * c["sdp"] + 2 * c["rdp"] + c["matched_pct"]) / 9
    return {"match_factor": np.maximum(0.0, factor - penalty) * np.minimum(1.0, r.counts / 5)[None, :], "n_matched": c["n_matched"]}


def bounds(q: Side, r: Side, tolerance: float) -> dict | None:
    laid = islands(q, r, tolerance)
    if laid is None:
        return None
    strong = (r.intensity >= r.top()[r.owner] * 0.01).astype(float)
    return {"bound": laid[0](1.0) @ laid[1](strong).T / np.maximum(r.total(strong), 1)[None, :]}


def boosted(q: Side, r: Side) -> dict | None:
    """Squared weighted cosine blended with the consistency of neighbouring ratios, over equal m/z."""
    laid = islands(q, r, 0.0)
    if laid is None or (q.intensity <= 0).any() or (r.intensity <= 0).any():
        return None
    a, b = laid
    here_q, here_r, x, y = a(1.0) > 0, b(1.0) > 0, a(q.intensity), b(r.intensity)
    shared = _whole(a(1.0) @ b(1.0).T)
    dots = a(np.sqrt(q.intensity) * q.mz**2) @ b(np.sqrt(r.intensity) * r.mz**2).T
    norm = q.total(q.intensity * q.mz**4)[:, None] * r.total(r.intensity * r.mz**4)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(norm > 0, dots**2 / norm, 0.0)
        consistent = np.zeros(score.shape)
        rows = max(1, 1_000_000 // max(1, here_r.size))
        for i in range(0, len(x), rows):
            both = here_q[i : i + rows, None, :] & here_r[None, :, :]
            ratio = x[i : i + rows, None, :] / y[None, :, :]
            if both.all():
                step = ratio[:, :, 1:] / ratio[:, :, :-1]
                consistent[i : i + rows] = np.minimum(step, 1 / step).sum(2)
                continue
            last = np.maximum.accumulate(np.where(both, np.arange(both.shape[2]), -1), axis=2)
            before = last[:, :, :-1]
            step = ratio[:, :, 1:] / np.take_along_axis(ratio, np.maximum(before, 0), 2)
            consistent[i : i + rows] = np.where(both[:, :, 1:] & (before >= 0), np.minimum(step, 1 / step), 0.0).sum(2)
        union = q.counts[:, None] + r.counts[None, :] - shared
        blended = (union * score + shared * consistent / (shared - 1)) / (union + shared)
    return {"score": np.where(shared >= 2, blended, score), "shared": shared}
