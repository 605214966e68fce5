"""Peak detection and integration on one chromatogram (numpy arrays, no Spark)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Five-point derivative weights, the second at half scale and cut to eight digits.
FIRST, SECOND = np.array([-0.2, -0.1, 0.0, 0.1, 0.2]), np.array([0.14285714, -0.07142857, -0.1428571, -0.07142857, 0.14285714])
FIELDS = ("apex", "left", "right", "height", "area", "sn", "shape")


def lwma(x: np.ndarray, level: int, full: bool = True) -> np.ndarray:
    """Triangular smoothing; taps beyond an end read the centre (``full``) or are left out of the norm."""
    n, total, norm = len(x), (level + 1) * x.astype(float), np.full(len(x), float(level + 1))
    for k in range(1, level + 1):
        weight = level + 1 - k
        for side in (-k, k):
            at = np.arange(n) + side
            inside = (at >= 0) & (at < n)
            total += weight * np.where(inside, x[np.clip(at, 0, max(n - 1, 0))], x if full else 0.0)
            norm += weight * (inside | full)
    return total / norm


def upper_median(x: np.ndarray) -> float:
    return float(np.sort(x)[len(x) // 2]) if len(x) else 0.0


def five_points(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    if len(x) >= 5:
        out[2:-2] = np.convolve(x, weights[::-1], "valid")
    return out


def baseline_noise(x: np.ndarray, window: int = 1, wide: int = 20, size: int = 50, least: int = 10, factor: float = 3.0) -> tuple[np.ndarray, float, float]:
    """Corrected signal, amplitude noise and noise level (``factor`` times it)."""
    signal = lwma(lwma(x, window, False), window, False)
    corrected = np.maximum(signal - lwma(x, wide, False), 0.0)
    full = corrected[: len(x) // size * size].reshape(-1, size)
    amplitude = float(np.median(full.max(1) - full.min(1))) if len(full) >= least else 1.0
    return corrected, amplitude, amplitude * factor


def maxima(x: np.ndarray, height: float, width: float) -> np.ndarray:
    """Middles of plateaus above both neighbours, of at least ``height`` and half-prominence width ``width``."""
    edge = np.flatnonzero(np.diff(x) != 0)
    begin, end = np.r_[0, edge + 1], np.r_[edge, len(x) - 1]
    inner = (begin > 0) & (end < len(x) - 1)
    begin, end = begin[inner], end[inner]
    top = (x[begin - 1] < x[begin]) & (x[end + 1] < x[end])
    found = (begin[top] + end[top]) // 2
    found = found[x[found] >= height]
    keep = []
    for p in found.tolist():
        higher = np.flatnonzero(x > x[p])
        left = higher[higher < p].max(initial=-1) + 1
        right = higher[higher > p].min(initial=len(x)) - 1
        level = x[p] - 0.5 * (x[p] - max(x[left : p + 1].min(), x[p : right + 1].min()))
        a, b = p, p
        while a > left and x[a] > level:
            a -= 1
        while b < right and x[b] > level:
            b += 1
        begin_at = a + (level - x[a]) / (x[a + 1] - x[a]) if x[a] < level else float(a)
        end_at = b - (level - x[b]) / (x[b - 1] - x[b]) if x[b] < level else float(b)
        if end_at - begin_at >= width:
            keep.append(p)
    return np.array(keep, np.int64)


def flank(x: np.ndarray, apex: int, step: int, share: float = 0.05) -> int:
    """From the apex to the nearest valley or the first point at or below ``share`` of it."""
    at, last = apex, len(x) - 1 if step > 0 else 0
    while at != last and x[at] > x[apex] * share and x[at + step] <= x[at]:
        at += step
    return at


def longest_alive(x: np.ndarray) -> int:
    """Length of the longest run above 0."""
    alive = np.r_[0, (x > 0).astype(int), 0]
    turns = np.flatnonzero(np.diff(alive))
    return int((turns[1::2] - turns[::2]).max(initial=0))


def gaussian_likeness(rt: np.ndarray, x: np.ndarray) -> float:
    """Correlation with the gaussian of the curve's own moments, 0 to 1."""
    weight = np.maximum(x, 0.0)
    mass = float(weight.sum())
    if len(x) < 4 or mass < 1e-10:
        return 0.0
    mu = float((rt * weight).sum()) / mass
    sigma = max(float(np.sqrt((weight * (rt - mu) ** 2).sum() / mass)), 1e-10)
    model = x.max() * np.exp(-0.5 * ((rt - mu) / sigma) ** 2)
    if x.std() < 1e-10 or model.std() < 1e-10:
        return 0.0
    return float(np.clip(((x - x.mean()) * (model - model.mean())).mean() / (x.std() * model.std()), 0, 1))


def area_seconds(rt: np.ndarray, x: np.ndarray) -> float:
    """Trapezoid area with RT taken from minutes to seconds."""
    return float(((x[1:] + x[:-1]) * np.abs(np.diff(rt))).sum() / 2 * 60)


def builtin_peaks(rt: np.ndarray, x: np.ndarray, least: float = 1000.0, points: int = 3, window: int = 1, wide: int = 20, fold: float = 4.0, shape: float = 0.0, ratio: float = 0.0, rt_window: tuple[float, float] | None = None) -> list[dict]:
    """Local maxima of the corrected curve that pass the width, signal, prominence and shape gates."""
    if len(x) < points + 2:
        return []
    corrected, amplitude, level = baseline_noise(x, window, wide)
    out = []
    for p in maxima(corrected, 1.0, points).tolist():
        if rt_window and not rt_window[0] <= rt[p] <= rt_window[1]:
            continue
        left, right = flank(corrected, p, -1), flank(corrected, p, 1)
        raw = x[left : right + 1]
        if right - left + 1 < points or longest_alive(raw) < points or (raw == 0).mean() > 0.2:
            continue
        rise = sorted((corrected[p] - corrected[left], corrected[p] - corrected[right]))
        if rise[1] < level or rise[0] < least or rise[0] < amplitude * fold:
            continue
        if ratio > 0 and corrected[p] > 0 and rise[0] / corrected[p] < ratio:
            continue
        piece = corrected[left : right + 1]
        likeness = gaussian_likeness(rt[left : right + 1], piece)
        if shape > 0 and likeness < shape:
            continue
        out.append({"apex": p, "left": left, "right": right, "height": float(corrected[p]), "area": area_seconds(rt[left : right + 1], piece), "sn": float(corrected[p]) / max(amplitude, 1.0), "shape": likeness})
    return out


@dataclass(frozen=True)
class Spotting:
    """Settings of the derivative detector."""

    level: int = 3
    wide: int = 20
    bin: int = 50
    factor: float = 3.0
    bins: int = 10
    amplitude: float = 1000.0
    points: float = 5
    amplitude_fold: float = 4.0
    slope_fold: float = 2.0
    width: int = 20
    spikes: int = 15
    small: float = 0.05


def shifted(x: np.ndarray, k: int) -> np.ndarray:
    """x at k places on, NaN beyond the ends; comparisons with NaN are false."""
    out = np.full(len(x), np.nan)
    if k >= 0:
        out[: len(x) - k] = x[k:]
    else:
        out[-k:] = x[:k]
    return out


def shape_flags(x: np.ndarray) -> dict[str, np.ndarray]:
    a, b, d, e = (shifted(x, k) for k in (-2, -1, 1, 2))
    crest, trough = (b <= x) & (x >= d), (b >= x) & (x <= d)
    top = crest & ((b != x) | (x != d))
    return {"top": top, "large_top": (a <= b) & top & (d >= e), "broad_top": crest & ((a <= b) | (d >= e)), "bottom": trough, "large_bottom": (a >= b) & trough & (d <= e)}


def walk_down(x: np.ndarray, at: int, step: int, most: int = 6) -> int:
    """Steps (``most`` at most) from ``at`` while each next point is strictly lower."""
    n = 0
    while n < most and 0 <= at + step * (n + 1) < len(x) and x[at + step * n] > x[at + step * (n + 1)]:
        n += 1
    return n


def global_noise(corrected: np.ndarray, s: Spotting) -> tuple[float, float]:
    """Noise (upper median amplitude of the bins that are not flat, times the factor) and estimated noise."""
    bins = [corrected[i : i + s.bin] for i in range(0, len(corrected), s.bin)]
    spread = np.array([b.max() - b.min() for b in bins])
    spread = spread[spread > 0]
    noise = upper_median(spread) * s.factor if len(spread) >= s.bins else 0.0
    return noise, max(1.0, noise / s.factor)


def small_steps(values: np.ndarray, top: float, s: Spotting) -> float:
    few = values[(values > 0) & (values < top * s.small)]
    return upper_median(few) if len(few) else 1e-4


def spike_count(raw: np.ndarray, flags: dict[str, np.ndarray], begin: int, end: int, limit: float) -> int:
    """Pairs of a top and a bottom, as they come, that differ by more than twice ``limit``."""
    n, top, low = 0, None, None
    for i in range(max(begin, 1), min(end, len(raw) - 2) + 1):
        if flags["top"][i]:
            top = raw[i]
        elif flags["bottom"][i]:
            low = raw[i]
        if top is not None and low is not None:
            n += abs(top - low) / 2 > limit
            top = low = None
    return n


def measure(rt: np.ndarray, y: np.ndarray, top: int, begin: int, end: int, rise: float, noise: float) -> dict | None:
    """A peak over begin .. end (inclusive) of the smoothed curve, or None if it is too short."""
    if end - begin < 3 or rise < 0:
        return None
    lower = y[begin] <= y[end]
    base = y[begin] if lower else y[end]
    side = np.arange(top, begin - 1, -1) if lower else np.arange(top, end + 1)
    half = side[np.argmin(np.abs((y[top] - base) / 2 - (y[side] - base)))]
    sigma = abs(rt[half] - rt[top]) / np.sqrt(2 * np.log(2))
    bell = (y[top] - base) * sigma * np.sqrt(2 * np.pi) / 2
    pieces = (y[begin + 1 : end + 1] + y[begin:end]) * np.abs(np.diff(rt[begin : end + 1])) / 2
    whole, first = float(pieces.sum()), float(pieces[: top - begin].sum())
    second = whole - first if end - 1 != top - 1 else 0.0
    halves = first - base * (rt[top] - rt[begin]), second - base * (rt[end] - rt[top])
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.float64(min(bell, h)) / np.float64(max(bell, h)) for h in halves]
    above = whole - (y[end] + y[begin]) * abs(rt[end] - rt[begin]) / 2
    return {"apex": top, "left": begin, "right": end, "height": float(y[top]), "area": float(above * 60), "sn": rise / noise, "shape": float(sum(parts) / 2)}


def derivative_peaks(rt: np.ndarray, x: np.ndarray, s: Spotting = Spotting()) -> list[dict]:
    """Peaks by slope: a start where two slopes in a row are steep, an end past the top where it flattens out.

    Flags of all positions are computed first; the walk then jumps from flag to flag.
    """
    raw = np.asarray(x, float)
    n = len(raw)
    if n < 5:
        return []
    y = lwma(raw, s.level)
    ss = lwma(lwma(y, 1), 1)
    noise, estimated = global_noise(np.maximum(ss - lwma(y, s.wide), 0.0), s)
    middle, high_base = upper_median(y), upper_median(y) > (y.max() + y.min()) / 2
    d1, d2 = five_points(ss, FIRST), five_points(ss, SECOND)
    steps = np.abs(np.diff(ss))
    amp = small_steps(steps, steps.max(initial=0.0), s)
    slope = small_steps(np.abs(d1), np.abs(d1).max(initial=0.0), s)
    bend = small_steps(-d2, (-d2).max(initial=0.0), s)
    flags = shape_flags(ss)
    rises = shifted(d1, -1) > 0
    curved = rises & (shifted(d1, 1) < 0) & (d2 < -bend)
    first_top = (rises & (d1 < 0)) | curved | flags["large_top"]
    still = (np.abs(shifted(ss, -1) - ss) < amp) & (np.abs(ss - shifted(ss, 1)) < amp)
    stops = (d1 > -slope * s.slope_fold) | np.r_[False, still[:-1]] | flags["large_bottom"]
    after_top = 1 if s.points <= 3 else s.points / 2
    steep = (d1 > slope * s.slope_fold) & (shifted(d1, 1) > slope * s.slope_fold)
    margin, found, guard = max(int(s.points), 2), [], None
    i = margin
    while i < n - margin:
        ahead = np.flatnonzero(steep[i : n - margin])
        if not len(ahead):
            break
        i += int(ahead[0])
        begin = i - walk_down(ss, i, -1)
        js = np.arange(i + 1, n - 2)
        event = curved[js].copy()
        tops = np.flatnonzero(first_top[js])
        event[: tops[0] if len(tops) else len(js)] = False
        if len(tops):
            event[tops[0]] = True
        last = np.where(np.cumsum(event) > 0, np.maximum.accumulate(np.where(event, js, -1)), n * 2)
        over = np.flatnonzero(stops[js] & (last + after_top <= js - 1))
        j = int(js[over[0]]) if len(over) else max(i, n - 3)
        back = walk_down(ss, j, -1)
        if back:
            j -= back
            if guard == j and j > n - 10:
                break
            guard = j
        else:
            j += walk_down(ss, j, 1)
        i = max(i, j)
        if j - begin + 1 >= s.points:
            top = begin + int(np.argmax(y[begin : j + 1]))
            low = [k for k in range(top - s.width, begin, -1) if y[k - 1] >= y[k]]
            far = [k for k in range(top + s.width, j) if y[k] <= y[k + 1]]
            a, b = (low[0] if low else begin), (far[0] if far else j)
            rise = sorted((y[top] - y[a], y[top] - y[b]))
            noisy = rise[1] < noise or rise[0] < s.amplitude or rise[0] < amp * s.amplitude_fold or (high_base and min(y[a], y[b]) < middle)
            peak = None if noisy else measure(rt, y, top, a, b, float(rise[1]), estimated)
            if peak and peak["height"] > 0:
                found.append(peak)
        i += 1
    own = shape_flags(raw)
    out = []
    for p in found:
        t = p["apex"]
        if not (0 < t < n - 1 and raw[t - 1] > 0 and raw[t + 1] > 0):
            continue
        reach, limit = min(10 * (p["right"] - p["left"]), 50), max(p["height"] - y[p["left"]], p["height"] - y[p["right"]]) / 3
        if spike_count(raw, own, p["left"] - reach, p["left"], limit) + spike_count(raw, own, p["right"], p["right"] + reach, limit) < s.spikes:
            out.append(p)
    return sorted(out, key=lambda p: p["apex"])


def fill_gap(rt: np.ndarray, x: np.ndarray, centre: float, tolerance: float, noise: float, level: int = 1, force: bool = True) -> dict:
    """Integrate the broad top nearest to ``centre``; without one, frame the nearest point (at most five a side)."""
    none = {"status": "no_signal", "height": 0.0, "area": 0.0, "apex": -1, "left": -1, "right": -1, "sn": 0.0, "forced": False}
    n = len(x)
    if not n:
        return none
    y = lwma(np.asarray(x, float), level)
    flags = shape_flags(y)
    inside = flags["broad_top"] & (rt >= centre - tolerance) & (rt <= centre + tolerance)
    inside[:2] = inside[-2:] = False
    tops = np.flatnonzero(inside)
    forced = not len(tops)
    if forced and not force:
        return none

    def slide(at: int, step: int, limit: int, hard: bool) -> int:
        while (at - limit) * step < 0 and (y[at + step] < y[at] if hard else y[at + step] <= y[at]):
            at += step
        return at

    if forced:
        top = int(np.argmin(np.abs(rt - centre)))
        left, right = slide(max(top - 1, 0), -1, max(top - 5, 0), False), slide(min(top + 1, n - 1), 1, min(top + 5, n - 1), False)
    else:
        top = int(tops[np.argmin(np.abs(rt[tops] - centre))])
        left, right = slide(max(top - 2, 0), -1, 0, True), slide(min(top + 2, n - 1), 1, n - 1, True)
        if not force and (top - left < 2 or right - top < 2):
            return none
        better = [i for i in range(left + 1, right) if flags["top"][i] and y[i] > y[top]]
        top = max(better, key=lambda i: (y[i], -i)) if better else top
    area = area_seconds(rt[left : right + 1], y[left : right + 1]) - (y[left] + y[right]) * abs(rt[right] - rt[left]) / 2 * 60
    height = float(y[top])
    return {"status": "filled" if height > 0 else "no_signal", "height": height, "area": float(area), "apex": top, "left": left, "right": right, "sn": height / noise if noise > 0 else 0.0, "forced": forced}


def savitzky_golay(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares polynomial smoothing; the ends are read off the polynomials of the first and last window."""
    half, n = window // 2, len(x)
    if n < window:
        return x.astype(float)
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    out = np.convolve(x, fit[0][::-1], "same").astype(float)
    out[:half], out[n - half :] = (basis @ fit @ x[:window])[:half], (basis @ fit @ x[-window:])[window - half :]
    return out


def gaussian_smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing to four sigmas with mirrored ends."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(x, float), reach, "symmetric"), kernel / kernel.sum(), "valid")


def smooth(x: np.ndarray, how: str, window: int = 5, order: int = 2, sigma: float = 1.0) -> np.ndarray:
    """savgol, gaussian, moving_average or none; never below 0."""
    kinds = {"savgol": lambda: savitzky_golay(x, window, order), "gaussian": lambda: gaussian_smooth(x, sigma), "moving_average": lambda: np.convolve(x, np.ones(window) / window, "same"), "none": lambda: np.asarray(x, float)}
    return np.maximum(kinds[how](), 0.0)


def shape_scores(y: np.ndarray, left: int, apex: int, right: int) -> tuple[float, float] | None:
    """Sharpness (mean over the sides of the steepest drop a scan, by the root of the apex) and ideal slope.

    The ideal slope is the surplus of steps towards the apex over those against it, as a share of the former. None
    for four points or fewer than that, an apex below both ends or not above 0.
    """
    top = float(y[apex])
    if right - left < 3 or top <= 0 or (top < y[left] and top < y[right]):
        return None
    steps = np.r_[np.diff(y[left : apex + 1]), -np.diff(y[apex : right + 1])]
    good, bad = float(steps.clip(min=0).sum()), float((-steps).clip(min=0).sum())
    drop = lambda xs: float(((top - xs) / np.arange(1, len(xs) + 1)).max()) / np.sqrt(top) if len(xs) else -np.inf
    sharp = (drop(y[left:apex][::-1]) + drop(y[apex + 1 : right + 1])) / 2
    return float(sharp), max(0.0, (good - bad) / good) if good > 0 else 0.0


def regions(response: np.ndarray, margin: int = 5) -> list[tuple[int, int]]:
    """Runs of positive response away from the ends, opened on a rise and cut at local minima."""
    out, begin, i = [], None, margin
    while i < len(response) - margin:
        if begin is None:
            if response[i] > 0 and response[i - 1] < response[i]:
                begin = i
        elif response[i] <= 0:
            out.append((begin, i - 1))
            begin = None
        elif response[i - 1] > response[i] < response[i + 1]:
            out.append((begin, i))
            begin, i = i + 1, i + 1
        i += 1
    return out


def matched_filter(x: np.ndarray, sigma: float = 0.5, half: int = 10) -> np.ndarray:
    t = np.arange(-half, half + 1) / sigma
    return np.convolve(x, (1 - t * t) * np.exp(-0.5 * t * t), "same") if len(x) > 2 * half else np.convolve(x, (1 - t * t) * np.exp(-0.5 * t * t), "full")[half : half + len(x)]


def parabola_apex(a: float, b: float, c: float) -> tuple[float, float]:
    """Offset and height of the vertex through three neighbours; the middle where they do not bend down."""
    bend = a - 2 * b + c
    if bend >= 0:
        return 0.0, b
    shift = float(np.clip(0.5 * (a - c) / bend, -1, 1))
    return shift, b - 0.25 * (a - c) * shift
