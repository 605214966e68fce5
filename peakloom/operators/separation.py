"""Spectra of co-eluting compounds: one window of a run a row, its ion traces as a matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.operators.kernelled import map_groups, stream_groups


def matrix(ion: np.ndarray, scan: np.ndarray, intensity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ions, scans, traces) of long rows; missing cells are 0."""
    ions, rows = np.unique(ion, return_inverse=True)
    scans, columns = np.unique(scan, return_inverse=True)
    traces = np.zeros((len(ions), len(scans)))
    np.add.at(traces, (rows, columns), intensity)
    return ions, scans, traces


def separate_windows(series: DataFrame, keys: list[str], **options) -> DataFrame:
    """Spectrum of the compound at each window's tallest scan; ``series`` has ion, scan and intensity."""
    from peakloom.kernels.deconvolution import Settings, separate

    settings = Settings(**options)

    def kernel(ion, scan, intensity):
        ions, _, traces = matrix(ion, scan, intensity)
        apex = int(np.argmax(traces.sum(0)))
        return [{"mz": float(m), "height": float(h)} for m, h in zip(*separate(ions, traces, apex, s=settings))]

    return map_groups(series, keys, ["ion", "scan"], ["ion", "scan", "intensity"], kernel, "mz double, height double")


def extract_compounds(series: DataFrame, keys: list[str], noise: float | None = None) -> DataFrame:
    """All compounds of each window: scan, m/z, height and flag of each fitted ion."""
    from peakloom.kernels.deconvolution import extract_components

    def kernel(ion, scan, intensity):
        ions, _, traces = matrix(ion, scan, intensity)
        return [{"scan": c["scan"], "mz": m, "height": h, "flagged": f} for c in extract_components(ions, traces, noise) for m, h, f in c["peaks"]]

    return map_groups(series, keys, ["ion", "scan"], ["ion", "scan", "intensity"], kernel, "scan double, mz double, height double, flagged boolean")


def perceive(series: DataFrame, keys: list[str], noise: float | None = None) -> DataFrame:
    """Components of each window: place in scans, bounds and number of ions."""
    from peakloom.kernels.deconvolution import components, noise_factor

    def kernel(ion, scan, intensity):
        _, _, traces = matrix(ion, scan, intensity)
        found = components(traces, noise_factor(traces) if noise is None else noise)
        return [{"scan": float(c["scan"]), "lo": c["lo"], "hi": c["hi"], "ions": len(c["ions"])} for c in found]

    return map_groups(series, keys, ["ion", "scan"], ["ion", "scan", "intensity"], kernel, "scan double, lo long, hi long, ions long")


def coelution_verdicts(series: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict on each ion of a window around its tallest scan."""
    from peakloom.kernels.ions import coelution

    def kernel(ion, scan, intensity):
        ions, _, traces = matrix(ion, scan, intensity)
        apex = int(np.argmax(traces.sum(0)))
        left, right = max(0, apex - 6), min(traces.shape[1] - 1, apex + 6)
        told = coelution(traces[:, apex], traces, [[] for _ in ions], left, apex, right)
        return [{"ion": float(i), "kept": k, "reason": why} for i, (k, why) in zip(ions, told)]

    return map_groups(series, keys, ["ion", "scan"], ["ion", "scan", "intensity"], kernel, "ion double, kept boolean, reason string")


def merge_regions(regions: DataFrame, keys: list[str], width: float, share: float = 0.5) -> DataFrame:
    """Ids of the regions (id, mz, left, right, apex, height) that stay, by one sweep of each group from low to high m/z."""
    from peakloom.kernels.sweeps import MergedRegions

    return stream_groups(regions, keys, ["mz", "id"], ["id", "mz", "left", "right", "apex", "height"], lambda: MergedRegions(width, share), "id long", ranged=True)


def drop_slice_twins(peaks: DataFrame, keys: list[str], tolerance: float, cap: float) -> DataFrame:
    """Ids of peaks (id, slice, mz, left, right, apex, height) that are no weaker twin of one in the last slice kept; two slices are held at a time."""
    from peakloom.kernels.sweeps import SliceTwins

    return stream_groups(peaks, keys, ["slice", "apex", "id"], ["id", "slice", "mz", "left", "right", "apex", "height"], lambda: SliceTwins(tolerance, cap), "id long", ranged=True)


def running_mean_eics(points: DataFrame, keys: list[str], channel: str, tolerance: float = 0.02, least_intensity: float = 10.0, least_scans: int = 3, ppm: float = 100.0) -> DataFrame:
    """Chromatograms of a channel's product ions by running-mean bins: keys, mz (of the bin), scan and intensity.

    A group is the centroids of one channel of one run. Bins are made of points of at least ``least_intensity`` and as wide as ``tolerance`` or
    ``ppm`` of the channel, whichever is more; bins with signal in fewer than ``least_scans`` scans are left out.
    """
    from peakloom.kernels.sweeps import RunningMean

    rows = points.withColumn("channel_mz", F.col(channel).cast("double"))
    start = lambda: RunningMean(tolerance, least_intensity, least_scans, ppm)
    return stream_groups(rows, keys, ["mz", "scan", "intensity"], ["mz", "scan", "intensity", "channel_mz"], start, "mz double, scan long, intensity double")


def recall_ions(series: DataFrame, clusters: DataFrame, keys: list[str], channel: str, **options) -> DataFrame:
    """Further ions of each cluster: keys, id, mz and height.

    ``series`` has keys, ion (m/z), scan, rt and intensity of every ion of a channel; ``clusters`` has keys, id, rt and mzs (the ions that the cluster
    has). An ion alive around a cluster's centre is recalled unless another cluster's centre is nearer to its local top; 50 a cluster at most.
    """
    from peakloom.kernels.ions import recall

    others = clusters.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "rt", "mzs"))).alias("__c"))
    others = others.select(*keys, F.transform("__c", lambda c: c["id"]).alias("ids"), F.transform("__c", lambda c: c["rt"]).alias("centres"), F.transform("__c", lambda c: c["mzs"]).alias("mzs"))
    rows = series.join(others, keys).withColumn("__channel", F.col(channel).cast("double"))

    def kernel(ion, scan, rt, intensity, ids, centres, mzs, __channel):
        ions, scans, traces = matrix(ion, scan, intensity)
        times = _times(scan, rt, scans)
        out = []
        for k, centre in enumerate(centres[0]):
            rest = [float(c) for j, c in enumerate(centres[0]) if j != k]
            taken = {round(float(m) * 200) for m in mzs[0][k]}
            out += [{"id": int(ids[0][k]), "mz": m, "height": h} for m, h in recall(ions, traces, times, float(centre), rest, taken, float(__channel[0]), **options)]
        return out

    return map_groups(rows, keys, ["ion", "scan"], ["ion", "scan", "rt", "intensity", "ids", "centres", "mzs", "__channel"], kernel, "id long, mz double, height double")


def _times(scan: np.ndarray, rt: np.ndarray, scans: np.ndarray) -> np.ndarray:
    """The RT of each of the sorted scans."""
    out = np.zeros(len(scans))
    out[np.searchsorted(scans, scan)] = rt
    return out
