"""Similarity of two spectra given as arrays of m/z and intensity."""

from __future__ import annotations

import numpy as np

#: The penalty for reference spectra of 1, 2, 3 and 4 to 5 peaks.
PENALTY = {0: 0.75, 1: 0.75, 2: 0.88, 3: 0.94, 4: 0.97, 5: 0.97}
TINY = 1e-12


def match(mz_a, int_a, mz_b, int_b, tolerance: float, shift: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Indices of a 1:1 matching: candidate pairs by falling intensity product, ties in peak order.

    Candidates of each peak are a slice of the sorted other side, so that no full matrix is made.
    """
    order = np.argsort(mz_b, kind="stable")
    ranked = mz_b[order]
    low = np.searchsorted(ranked, mz_a - shift - tolerance * (1 + 1e-9) - 1e-9, "left")
    high = np.searchsorted(ranked, mz_a - shift + tolerance * (1 + 1e-9) + 1e-9, "right")
    many = high - low
    a = np.repeat(np.arange(len(mz_a)), many)
    b = order[np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
    close = np.abs(mz_a[a] - mz_b[b] - shift) <= tolerance
    a, b = a[close], b[close]
    if not len(a):
        return a, b
    if len(np.unique(a)) == len(a) and len(np.unique(b)) == len(b):  # nothing competes
        rank = np.lexsort((b, a, -(int_a[a] * int_b[b])))
        return a[rank], b[rank]
    free_a, free_b, chosen = np.ones(len(mz_a), bool), np.ones(len(mz_b), bool), []
    for k in np.lexsort((b, a, -(int_a[a] * int_b[b]))):
        if free_a[a[k]] and free_b[b[k]]:
            free_a[a[k]] = free_b[b[k]] = False
            chosen.append(k)
    return a[chosen], b[chosen]


def product(mz_a, int_a, mz_b, int_b, tolerance: float, shift: float = 0.0) -> tuple[float, int]:
    """Sum of the matched intensity products and the number of matches."""
    a, b = match(mz_a, int_a, mz_b, int_b, tolerance, shift)
    return float((int_a[a] * int_b[b]).sum()), len(a)


def _ratio(total: float, int_a, int_b) -> float:
    norm = float(np.sqrt((int_a * int_a).sum())), float(np.sqrt((int_b * int_b).sum()))
    return min(total / (norm[0] * norm[1]), 1.0) if min(norm) >= TINY else 0.0


def cosine(mz_a, int_a, mz_b, int_b, tolerance: float) -> tuple[float, int]:
    """Cosine over matched peaks and their number."""
    total, n = product(mz_a, int_a, mz_b, int_b, tolerance)
    score = _ratio(total, int_a, int_b)
    return score, n if min(float(int_a.sum() if len(int_a) else 0), float(int_b.sum() if len(int_b) else 0)) > 0 else 0


def modified_cosine(mz_a, int_a, mz_b, int_b, precursor_a: float, precursor_b: float, tolerance: float, exclusion: float = 1.5) -> tuple[float, int]:
    """The better of the direct and the precursor-shifted cosine, without the precursors' surroundings."""
    far_a, far_b = np.abs(mz_a - precursor_a) > exclusion, np.abs(mz_b - precursor_b) > exclusion
    sides = mz_a[far_a], int_a[far_a], mz_b[far_b], int_b[far_b]
    if not len(sides[0]) or not len(sides[2]) or not sides[1].any() or not sides[3].any():
        return 0.0, 0
    direct, moved = product(*sides, tolerance), product(*sides, tolerance, precursor_b - precursor_a)
    total, n = moved if moved[0] > direct[0] else direct
    return _ratio(total, sides[1], sides[3]), n


def neutral_loss_cosine(mz_a, int_a, mz_b, int_b, precursor_a: float, precursor_b: float, tolerance: float) -> tuple[float, int]:
    """Cosine of the positive losses from the precursor."""
    loss_a, loss_b = precursor_a - mz_a, precursor_b - mz_b
    return cosine(loss_a[loss_a > 0], int_a[loss_a > 0], loss_b[loss_b > 0], int_b[loss_b > 0], tolerance)


def composite(mz_q, int_q, mz_r, int_r, tolerance: float, precursor_q: float = 0.0, precursor_r: float = 0.0, rt_delta: float | None = None, rt_tolerance: float = 100.0) -> dict:
    """Weighted, simple and reverse dot products, matched share and their total.

    The frame shifted by the precursors' difference is taken if it matches more peaks. Peaks whose m/z agree
    with a matched one to four decimals count as matched. ``rt_delta`` in minutes adds a gaussian term.
    """
    none = {"score": 0.0, "n_matched": 0, "wdp": 0.0, "sdp": 0.0, "rdp": 0.0, "matched_pct": 0.0}
    if not len(mz_q) or not len(mz_r):
        return none
    q, r = match(mz_q, int_q, mz_r, int_r, tolerance)
    if precursor_q > 0 and precursor_r > 0:
        moved = match(mz_q, int_q, mz_r, int_r, tolerance, precursor_r - precursor_q)
        if len(moved[0]) > len(q):
            q, r = moved
    top_q, top_r = float(int_q.max()), float(int_r.max())
    if top_q < TINY or top_r < TINY:
        return none
    share_q, share_r = int_q / top_q, int_r / top_r
    middle, root = (mz_q[q] + mz_r[r]) / 2, np.sqrt(share_q[q] * share_r[r])

    def unmatched(mz, taken):
        known = {round(x, 4) for x in mz[taken].tolist()}
        return np.array([round(x, 4) not in known for x in mz.tolist()], bool)

    lone_q, lone_r = unmatched(mz_q, q), unmatched(mz_r, r)
    mass_q, mass_r = float((share_q[q] * middle).sum()), float((share_r[r] * middle).sum())
    all_q, all_r = mass_q + float((share_q * mz_q)[lone_q].sum()), mass_r + float((share_r * mz_r)[lone_r].sum())
    weighted, plain = float((root * middle).sum()) ** 2, float(root.sum()) ** 2
    penalty = PENALTY.get(len(mz_r), 1.0)
    dot = lambda top, x, y: min(top / (x * y) * penalty, 1.0) if x > TINY and y > TINY else 0.0
    wdp, sdp, rdp = dot(weighted, all_q, all_r), dot(plain, float(share_q.sum()), float(share_r.sum())), dot(weighted, mass_q, all_r)
    strong = int_r >= top_r * 0.01
    matched = int(strong[r].sum()) / max(int(strong.sum()), 1)
    score = (wdp**0.5 + sdp**0.5 + rdp**0.5) / 3 + matched
    if rt_delta is not None and rt_tolerance > 0:
        score += float(np.exp(-0.5 * (rt_delta / (rt_tolerance / 60)) ** 2))
    return {"score": score, "n_matched": len(q), "wdp": wdp, "sdp": sdp, "rdp": rdp, "matched_pct": matched}


def identity(mz_a, int_a, mz_b, int_b, tolerance: float = 0.02, least: float = 0.5, peaks: int = 3) -> tuple[str, float, int]:
    """SAME, DIFFERENT or UNJUDGEABLE, with the cosine and the matches behind it."""
    if len(mz_a) < peaks or len(mz_b) < peaks:
        return "UNJUDGEABLE", 0.0, 0
    score, n = cosine(mz_a, int_a, mz_b, int_b, tolerance)
    return ("SAME" if score >= least and n >= peaks else "DIFFERENT"), score, n


def merge_close(mz, intensity, nominal: float, base: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged m/z, intensities and the index of each group's strongest member.

    Pass 1 chains peaks to the running weighted mean; pass 2 joins neighbours of the same intensity within three
    tolerances at their plain mean.
    """
    order = np.argsort(mz, kind="stable")
    width, groups = max(base, nominal * 1e-4), []
    for i in order.tolist():
        m, x = float(mz[i]), float(intensity[i])
        if groups and m - groups[-1][0] / max(groups[-1][1], TINY) <= width:
            g = groups[-1]
            g[0], g[1] = g[0] + m * x, g[1] + x
            if x > g[2]:
                g[2], g[3] = x, i
        else:
            groups.append([m * x, x, x, i])
    centres = [(g[0] / max(g[1], TINY), g[2], g[3]) for g in groups]
    if len(mz) <= 1:
        centres = [(float(mz[i]), float(intensity[i]), i) for i in order.tolist()]
    runs: list[list[tuple[float, float, int]]] = []
    for c in centres:
        if runs and c[1] == runs[-1][0][1] and c[0] - runs[-1][-1][0] <= 3 * width:
            runs[-1].append(c)
        else:
            runs.append([c])
    return np.array([float(np.mean([c[0] for c in r])) for r in runs]), np.array([r[0][1] for r in runs]), np.array([r[0][2] for r in runs], np.int64)


def clean(mz, intensity, precursor: float, base: float = 0.02, flat: int = 3, floor: float = 0.0, share: float = 0.0, beyond: float = 1.5, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Merge, drop intensities that occur ``flat`` times, floor, precursor cut, the ``most`` strongest, by m/z."""
    if not len(mz):
        return mz, intensity
    mz, intensity, _ = merge_close(mz, intensity, precursor, base)
    _, inverse, counts = np.unique(intensity, return_inverse=True, return_counts=True)
    keep = counts[inverse] < flat
    mz, intensity = mz[keep], intensity[keep]
    if len(mz):
        keep = (intensity >= max(floor, share * intensity.max())) & (mz <= precursor + beyond)
        mz, intensity = mz[keep], intensity[keep]
    best = np.sort(np.lexsort((mz, -intensity))[:most])
    return mz[best], intensity[best]
