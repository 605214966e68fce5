"""Which ions belong to a feature, and which slices or regions show one compound twice."""

from __future__ import annotations

import numpy as np

from peakloom.kernels.peaks import longest_alive


def coelution(height: np.ndarray, traces: np.ndarray, apexes: list[list[int]], left: int, apex: int, right: int, near: int = 3, weak: float = 0.6, strong: float = 0.4, relaxed: float = 0.3, low: float = 0.005, big: float = 0.3, share: float = 0.3, least: int = 4, top: int = 3) -> list[tuple[bool, str]]:
    """Verdict on each ion of a spectrum: kept or not, and why.

    Kept are ions too low to judge, ions with a peak of their own near the apex, and ions whose trace follows the
    model: the mean of the strongest other ions' traces, each scaled to its maximum, or a gaussian without any.
    """
    base = float(height.max(initial=0.0))
    order = np.argsort(-traces[:, apex], kind="stable") if len(traces) else np.zeros(0, int)
    out = []
    for i, h in enumerate(height):
        if h < base * low:
            out.append((True, "low_response"))
            continue
        if any(abs(a - apex) <= near for a in apexes[i]):
            out.append((True, "apex_coincident"))
            continue
        others = [traces[j] / traces[j].max() for j in order[order != i][:top] if traces[j].max() > 0]
        model = np.mean(others, axis=0) if others else np.exp(-0.5 * ((np.arange(traces.shape[1]) - apex) / (max(right - left, 1) / 4)) ** 2)
        x, m = traces[i, max(0, left) : right + 1], model[max(0, left) : right + 1]
        r = None
        if len(x) >= least and ((x > 0) & (m > 0)).sum() >= least and x.std() >= 1e-9 and m.std() >= 1e-9:
            r = float(np.corrcoef(x, m)[0, 1])
        total = float(traces[i].sum())
        focus = float(traces[i, max(0, apex - 1) : apex + 2].sum()) / total if total > 0 else None
        loud = h >= base * big
        if r is not None and r >= (strong if loud else weak):
            out.append((True, "strong_pearson_pass" if loud else "pearson_pass"))
        elif r is not None and r >= relaxed and focus is not None and focus >= share:
            out.append((True, "concentration_pass"))
        else:
            out.append((False, "no_peak_no_corr"))
    return out


def slice_redundancy(slices: np.ndarray, mass, apex, left, right, height, mass_tolerance: float, cap: float) -> np.ndarray:
    """Which peaks stay when each slice is compared with the last one that kept any: of two alike the taller stays."""
    keep, before = np.ones(len(mass), bool), []
    for s in np.unique(slices):
        now = np.flatnonzero(slices == s).tolist()
        for i in list(now):
            for j in list(before):
                first, second = (j, i) if apex[j] <= apex[i] else (i, j)
                alike = abs(mass[i] - mass[j]) <= mass_tolerance and left[second] < apex[first]
                reach = min((right[i] - left[i] + right[j] - left[j]) / 4, cap)
                if alike and abs(apex[i] - apex[j]) <= reach:
                    loser = j if height[i] > height[j] else i
                    keep[loser] = False
                    if loser == i:
                        break
                    before.remove(j)
            if not before:
                break
        now = [i for i in now if keep[i]]
        before = now or before
    return keep


def merge_regions(mz, left, right, apex, height, width: float, share: float = 0.5, cap: float = 0.1, overlap: float = 0.8) -> np.ndarray:
    """Which regions stay: of two within ``share`` of a slice whose apexes are close, or whose times mostly coincide, the taller."""
    order, keep = np.argsort(mz, kind="stable"), np.ones(len(mz), bool)
    for place, i in enumerate(order.tolist()):
        for j in order[place + 1 :].tolist():
            if not keep[i] or mz[j] - mz[i] > width * share:
                break
            if not keep[j] or right[i] < left[j] or right[j] < left[i]:
                continue
            half = min((right[i] - left[i] + right[j] - left[j]) / 4, cap) or cap
            shared, narrow = min(right[i], right[j]) - max(left[i], left[j]), min(right[i] - left[i], right[j] - left[j])
            cover = 0.0 if shared <= 0 else 1.0 if narrow <= 0 else shared / narrow
            if abs(apex[i] - apex[j]) <= half or cover >= overlap:
                keep[j if height[i] >= height[j] else i] = False
    return keep


def recall(mz: np.ndarray, traces: np.ndarray, rt: np.ndarray, centre: float, others: list[float], taken: set[int], precursor: float, window: int = 2, least: float = 200.0, run: int = 4, most: int = 50) -> list[tuple[float, float]]:
    """(m/z, height) of further ions alive around a cluster's centre, unless another cluster's centre is nearer to their local top."""
    apex = int(np.argmin(np.abs(rt - centre)))
    lo, hi = max(0, apex - window), min(len(rt) - 1, apex + window)
    out, taken = [], set(taken)
    for m, x in zip(mz.tolist(), traces):
        cell = round(m * 200)
        piece = x[lo : hi + 1]
        if len(out) == most:
            break
        if cell in taken or abs(m - precursor) < 1.5 or piece.max() < least or longest_alive(piece) < run:
            continue
        at = rt[lo + int(np.argmax(piece))]
        if any(abs(o - at) < abs(centre - at) - 1e-9 for o in others if np.isfinite(o)):
            continue
        out.append((m, float(piece.max())))
        taken.add(cell)
    return out
