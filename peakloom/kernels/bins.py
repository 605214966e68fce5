"""Running-mean bins of m/z values."""

from __future__ import annotations

import numpy as np


def running_mean_bins(mz: np.ndarray, intensity: np.ndarray, tolerance: float) -> np.ndarray:
    """Intensity-weighted means of runs of ascending m/z: a value joins while it is at most ``tolerance`` above the mean so far."""
    order = np.argsort(mz, kind="stable")
    values, weights = mz[order].tolist(), np.maximum(intensity[order], 1e-12).tolist()
    means: list[float] = []
    moment = weight = 0.0
    for v, w in zip(values, weights):
        if weight and v - moment / weight > tolerance:
            means.append(moment / weight)
            moment = weight = 0.0
        moment += v * w
        weight += w
    return np.array([*means, moment / weight] if weight else means)


def binned_maxima(bins: np.ndarray, mz: np.ndarray, scan: np.ndarray, intensity: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, scan, intensity): the strongest point of each bin and scan; a point counts for the bins next below and above it that are within reach."""
    above = np.minimum(np.searchsorted(bins, mz), len(bins) - 1)
    place = np.concatenate([above, np.maximum(above - 1, 0)])
    two = [np.concatenate([x, x]) for x in (mz, scan, intensity)]
    near = np.abs(two[0] - bins[place]) <= tolerance
    place, at, value = place[near], two[1][near], two[2][near]
    order = np.lexsort((-value, at, place))
    place, at, value = place[order], at[order], value[order]
    first = np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1])] if len(place) else np.zeros(0, bool)
    return place[first], at[first], value[first]
