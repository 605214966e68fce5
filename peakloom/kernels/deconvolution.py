"""Separation of co-eluting compounds: model chromatograms and least squares on ion traces."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from peakloom.kernels import peaks as P

PIVOT = 1e-10


def factorise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """LU factors in one array, row order and sign, with rows scaled for pivoting; a zero pivot becomes 1e-10.

    None if some row is all zero. Of equal pivots the lowest row is taken.
    """
    a = np.array(matrix, float)
    n = len(a)
    scale = np.abs(a).max(1)
    if (scale == 0).any():
        return None
    order, sign = np.arange(n), 1.0
    for k in range(n):
        for i in range(1, k):  # the part of column k above the diagonal
            a[i, k] -= a[i, :i] @ a[:i, k]
        a[k:, k] -= a[k:, :k] @ a[:k, k]
        size = np.abs(a[k:, k]) / scale[k:]
        best = n - 1 - int(np.argmax(size[::-1]))
        if best != k:
            for x in (a, scale, order):
                x[[k, best]] = x[[best, k]]
            sign = -sign
        if a[k, k] == 0:
            a[k, k] = PIVOT
        a[k + 1 :, k] /= a[k, k]
    return a, order, sign


def inverse(factors: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    a, order, _ = factors
    n = len(a)
    x = np.eye(n)[order]
    for i in range(n):
        x[i] -= a[i, :i] @ x[:i]
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - a[i, i + 1 :] @ x[i + 1 :]) / a[i, i]
    return x


def determinant(factors: tuple[np.ndarray, np.ndarray, float]) -> float:
    return float(factors[2] * np.diag(factors[0]).prod())


def target_row(basis: np.ndarray) -> np.ndarray | None:
    """Weights that give the first coefficient of a least-squares fit to the basis' rows, or None if singular."""
    factors = factorise(basis @ basis.T)
    if factors is None or determinant(factors) == 0:
        return None
    return inverse(factors)[0] @ basis


@dataclass(frozen=True)
class Settings:
    sigma: float = 0.5
    half: int = 10
    margin: int = 5
    amplitude: float = 500.0
    points: int = 5
    level: int = 3
    width: int = 5
    share: float = 0.9
    slope_high: float = 0.999
    slope_middle: float = 0.9
    apex_tolerance: int = 2
    edge: int = 3
    relative: float = 0.0
    cutoff: float = 0.0


def flatten_baseline(x: np.ndarray, apex: int) -> np.ndarray:
    """The trace above the line through the minima of its flanks; the line is cut to whole numbers."""
    left = int(np.argmin(x[: apex + 1][::-1]))
    left = apex - left
    right = apex + int(np.argmin(x[apex:]))
    slope = (x[right] - x[left]) / (right - left) if right > left else 0.0
    line = np.trunc(x[left] + slope * (np.arange(len(x)) - left))
    return np.maximum(x - line, 0.0)


@dataclass
class Trace:
    """A model chromatogram from scan ``left`` on."""

    left: int
    top: int
    values: np.ndarray

    @property
    def right(self) -> int:
        return self.left + len(self.values) - 1

    def on(self, begin: int, end: int) -> np.ndarray:
        out = np.zeros(end - begin + 1)
        a, b = max(begin, self.left), min(end, self.right)
        if a <= b:
            out[a - begin : b - begin + 1] = self.values[a - self.left : b - self.left + 1]
        return out


def trim(left: int, values: np.ndarray, s: Settings) -> Trace | None:
    """Cut a model at the first rise away from its top, half a peak width off at least; None with too short a side."""
    top, half = int(np.argmax(values)), s.width * 0.5
    down = [i for i in range(top, 0, -1) if top - i >= half and values[i - 1] >= values[i]]
    up = [i for i in range(top, len(values) - 1) if i - top >= half and values[i] <= values[i + 1]]
    a, b = (down[0] if down else 0), (up[0] if up else len(values) - 1)
    return Trace(left + a, left + top, values[a : b + 1]) if top - a >= s.edge and b - top >= s.edge else None


def model_traces(mz: np.ndarray, traces: np.ndarray, smooth: np.ndarray, rt: np.ndarray, s: Settings) -> list[Trace]:
    """One model per region of sharp peaks: the mean of the sharpest peaks' traces above their baselines."""
    spotting = P.Spotting(level=s.level, amplitude=s.amplitude, points=s.points, width=s.width)
    spots = []
    for ion, x in enumerate(traces):
        for p in P.derivative_peaks(rt, x, spotting):
            shape = P.shape_scores(smooth[ion], p["left"], p["apex"], p["right"])
            if shape:
                rank = 0 if shape[1] > s.slope_high else 1 if shape[1] > s.slope_middle else 2
                spots.append((rank, shape[0], ion, p))
    sharp = np.zeros(traces.shape[1])
    for rank, value, _, p in spots:
        if rank < 2:
            sharp[p["apex"]] = max(sharp[p["apex"]], value)
    models: dict[int, Trace] = {}
    for begin, end in P.regions(P.matched_filter(sharp, s.sigma, s.half), s.margin):
        inside = [x for x in spots if begin <= x[3]["apex"] <= end]
        if not inside:
            continue
        best = min(x[0] for x in inside)
        chosen = [x for x in inside if x[0] == best]
        limit = max(x[1] for x in chosen)
        chosen = sorted((x for x in chosen if x[1] >= limit * s.share), key=lambda x: (-x[1], x[3]["apex"], x[2]))
        a, b, top = (chosen[0][3][k] for k in ("left", "right", "apex"))
        mean = np.mean([flatten_baseline(smooth[x[2]][a : b + 1], top - a) for x in chosen], axis=0)
        model = trim(a, mean, s)
        if model and (model.top not in models or models[model.top].values.max() < model.values.max()):
            models[model.top] = model
    return [models[t] for t in sorted(models)]


def separate(mz: np.ndarray, traces: np.ndarray, apex: int, rt: np.ndarray | None = None, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the compound at ``apex``: each ion's share of the nearest model next to overlapping ones.

    Ions are fitted to the model, up to two models on each side that overlap it, a line and a constant. A share
    that is not positive is rescued where the ion rises and falls over four scans. Empty without a model near.
    """
    none = np.zeros(0), np.zeros(0)
    if not len(mz):
        return none
    rt = np.arange(traces.shape[1], dtype=float) if rt is None else rt
    smooth = np.array([P.lwma(x, s.level) for x in traces])
    models = model_traces(mz, traces, smooth, rt, s)
    if not models:
        return none
    k = int(np.argmin([abs(m.top - apex) for m in models]))
    target = models[k]
    if abs(target.top - apex) > s.apex_tolerance:
        return none
    lefts = next((models[k - n : k] for n in (2, 1) if k >= n and models[k - n].right > target.left), [])
    rights = next((models[k + 1 : k + n + 1] for n in (2, 1) if k + n < len(models) and models[k + n].left < target.right), [])
    begin, end = min(m.left for m in (target, *lefts)), max(m.right for m in (target, *rights))
    line = np.vstack([np.arange(end - begin + 1.0), np.ones(end - begin + 1)])
    weights = target_row(np.vstack([target.on(begin, end), *[m.on(begin, end) for m in (*lefts, *rights)], line]))
    if weights is None:
        weights = target_row(np.vstack([target.on(begin, end), line]))
        if weights is None:
            return none
    at, model = target.top - begin, target.on(begin, end)
    found: dict[float, tuple[float, float]] = {}
    for ion in np.argsort(mz, kind="stable").tolist():
        x = flatten_baseline(smooth[ion][begin : end + 1], at)
        if x[at] <= s.cutoff or model[at] == 0:
            continue
        share = float(weights @ x)
        if share <= 0:
            steep = 4 <= at <= len(x) - 5 and (np.diff(x[at - 4 : at]) > 0).all() and (np.diff(x[at + 1 : at + 5]) < 0).all()
            if not steep:
                continue
            share = x[at] / model[at]
        height = min(share * model[at], float(x[at]))
        key = round(float(mz[ion]), 4)
        if height > 0 and (key not in found or found[key][1] < height):
            found[key] = (float(mz[ion]), height)
    if not found:
        return none
    out = np.array(sorted(found.values()))
    keep = out[:, 1] > max(out[:, 1].max() * s.relative, s.cutoff)
    return out[keep, 0], out[keep, 1]


def noise_factor(traces: np.ndarray, size: int = 13, crossings: int = 7) -> float:
    """Median over ions of the median deviation by the root of the mean, on segments without zeros and with many mean crossings."""
    rows = []
    for x in [*traces, traces.sum(0)]:
        parts = x[: len(x) // size * size].reshape(-1, size)
        mean = parts.mean(1, keepdims=True)
        above = parts > mean
        good = (parts > 0).all(1) & ((above[:, 1:] != above[:, :-1]).sum(1) >= crossings)
        if good.any():
            rows.append(float(np.median(np.median(np.abs(parts - mean), 1)[good] / np.sqrt(mean[good, 0]))))
    return float(np.median(rows)) if rows else 1.0


def peak_window(x: np.ndarray, apex: int, noise: float, most: int = 12, jump: float = 5.0, fall: float = 0.05) -> tuple[int, int]:
    """Half-open window: out to a fall below ``fall`` of the apex, stopped before a rise of ``jump`` noise units over the least so far."""

    def reach(step: int) -> int:
        last = apex
        side = x[apex + 1 : apex + most + 1] if step > 0 else x[max(0, apex - most) : apex][::-1]
        low = np.minimum.accumulate(np.r_[x[apex], side])[1:]
        for k, (v, least) in enumerate(zip(side, low), 1):
            if least > 0 and v - least > jump * noise * np.sqrt(least):
                break
            last = apex + step * k
            if v <= x[apex] * fall:
                break
        return last

    return reach(-1), reach(1) + 1


def fitted_baseline(x: np.ndarray) -> np.ndarray:
    """Line through the ends, lowered below all points, refitted to the half of the points nearest to it."""
    n = len(x)
    if n < 2:
        return x.astype(float)
    at = np.arange(n)
    line = x[0] + (x[-1] - x[0]) * at / (n - 1)
    line = line + min(0.0, float((x - line).min()))
    low = np.argsort(x - line, kind="stable")[: max(2, n // 2)]
    return np.polyval(np.polyfit(at[low], x[low], 1), at) if at[low].std() > 0 else line


def ion_peaks(traces: np.ndarray, noise: float, least: float = 4.0) -> list[dict]:
    """Strict maxima that stand ``least`` noise units above their baseline, with sharpness and parabola apex."""
    out, safe = [], max(noise, 1e-9)
    for ion, x in enumerate(traces):
        tops = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:]) & (x[1:-1] > 0)) + 1
        for apex in tops[x[tops] >= least * safe * np.sqrt(x[tops])].tolist():
            lo, hi = peak_window(x, apex, noise)
            height = float(x[apex] - fitted_baseline(x[lo:hi])[apex - lo])
            if hi - lo < 3 or height < least * noise * np.sqrt(x[apex]):
                continue
            unit = safe * np.sqrt(x[apex])
            drop = lambda side: max(0.0, float(((x[apex] - side) / np.arange(1, len(side) + 1)).max(initial=0.0)) / unit)
            shift = P.parabola_apex(*x[apex - 1 : apex + 2])[0]
            out.append({"ion": ion, "apex": apex, "precise": apex + float(np.clip(shift, -0.5, 0.5)), "height": height, "sharp": (drop(x[lo:apex][::-1]) + drop(x[apex + 1 : hi])) / 2, "lo": lo, "hi": hi})
    return out


def components(traces: np.ndarray, noise: float, bins: int = 10, reach: float = 0.5, share: float = 0.75) -> list[dict]:
    """Compounds: places where summed sharpness, in bins of a tenth of a scan, is the greatest within ``reach`` scans.

    Ions whose own peak is within reach and at least ``share`` as sharp as the sharpest one contribute.
    """
    found = ion_peaks(traces, noise)
    if not found:
        return []
    place = np.array([p["precise"] for p in found])
    sharp = np.array([p["sharp"] for p in found])
    total = np.bincount(np.rint(place * bins).astype(int), sharp, traces.shape[1] * bins + 1)
    out, free = [], np.ones(len(found), bool)
    for cell in np.argsort(-total, kind="stable"):
        if total[cell] <= 0:
            break
        near = free & (np.abs(place - cell / bins) <= reach)
        if not near.any():
            continue
        chosen = [found[i] for i in np.flatnonzero(near & (sharp >= sharp[near].max() * share))]
        free &= ~near
        out.append({"scan": cell / bins, "ions": [p["ion"] for p in chosen], "lo": min(p["lo"] for p in chosen), "hi": max(p["hi"] for p in chosen)})
    return sorted(out, key=lambda c: c["scan"])


def extract_components(mz: np.ndarray, traces: np.ndarray, noise: float | None = None, reject: float = 0.6, flag: float = 0.2) -> list[dict]:
    """Spectra of all components: each ion is fitted to a constant, a line, the model and up to two neighbours.

    An ion whose shape differs from the model by more than ``reject`` is dropped, by more than ``flag`` (eased for
    weak signals) it is flagged.
    """
    noise = noise_factor(traces) if noise is None else noise
    comps, out = components(traces, noise), []
    models = []
    for c in comps:
        m = np.zeros(traces.shape[1])
        m[c["lo"] : c["hi"]] = traces[c["ions"], c["lo"] : c["hi"]].sum(0)
        models.append(m / m.max() if m.max() > 0 else m)
    for k, c in enumerate(comps):
        lo, hi = c["lo"], c["hi"]
        near = sorted((j for j in range(len(comps)) if j != k and comps[j]["lo"] < hi and comps[j]["hi"] > lo), key=lambda j: abs(comps[j]["scan"] - c["scan"]))[:2]
        model = models[k][lo:hi]
        basis = np.column_stack([np.ones(hi - lo), np.arange(hi - lo), model, *[models[j][lo:hi] for j in near]])
        fit = np.linalg.lstsq(basis, traces[:, lo:hi].T, rcond=None)[0][2]
        peaks = []
        for i in np.flatnonzero((fit > 0) & np.isfinite(fit)).tolist():
            x, share = traces[i, lo:hi], float(fit[i])
            if x.sum() <= 0:
                continue
            misfit = float(np.abs(x / x.sum() - model / model.sum()).sum()) / 2
            rest = float(np.abs(x - share * model).sum())
            ease = 20 / (np.sqrt(rest) / max(noise, 1e-9) + 20) if rest > 0 else 0.0
            if misfit <= reject:
                peaks.append((float(mz[i]), share, bool(misfit > flag + ease or share / (max(noise, 1e-9) * np.sqrt(share)) < 1)))
        out.append({"scan": float(c["scan"]), "peaks": peaks})
    return out
