"""Order-dependent operators: groups reach Python as sorted rows and are taken one after the other.

Groups are bounded by nature (the scans of a chromatogram) or are blocks of features that are linked, in chains, by the pairs that the
step looks at; so no placement can look beyond its block, and a block is no larger than the features that truly compete.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peakloom.plans import graph
from peakloom.plans.bands import box_join
from peakloom.plans.graph import linked_blocks

PIECE = 100_000  # rows after which results are handed on
PEAK = "apex long, left long, right long, height double, area double, sn double, shape double"


def schema_of(df: DataFrame, keys: list[str], more: str) -> StructType:
    return StructType(df.select(*keys).schema.fields + df.sparkSession.createDataFrame([], more).schema.fields)


def stream_groups(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], object], result: str, ranged: bool = False) -> DataFrame:
    """Feed the rows of each group, in ``order``, to an object of ``start()``: pieces of ``columns`` to ``feed``, then ``finish()``.

    Both return columns of ``result`` by name (arrays or lists) or None. Rows reach Python one by one, sorted, so memory is that of a piece and of
    what the object keeps. ``ranged`` spreads few large groups by ranges, where hashes would put several into one task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    wanted = list(dict.fromkeys([*order, *columns]))
    schema = schema_of(df, keys, result)
    arrow = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    names = [f.name for f in schema.fields[len(keys) :]]
    rows = df.select(*dict.fromkeys([*keys, *wanted]))
    rows = (rows.repartitionByRange(*keys) if ranged else rows.repartition(*keys)).sortWithinPartitions(*dict.fromkeys([*keys, *wanted]))

    def run(batches):
        owners, counts, found = [], [], {n: [] for n in names}

        def put(key, piece):
            if piece is None or not len(piece[names[0]]):
                return
            owners.append(key)
            counts.append(len(piece[names[0]]))
            for n in names:
                if isinstance(piece[n], list) and found[n] and isinstance(found[n][-1], list):
                    found[n][-1] += piece[n]
                else:
                    found[n].append(piece[n])

        def flush():
            at = pa.array(np.repeat(np.arange(len(owners)), counts))
            out = [pa.array([o[i] for o in owners], arrow[k]).take(at) for i, k in enumerate(keys)]
            out += [pa.concat_arrays([pa.array(x, arrow[n]) for x in found[n]]) for n in names]
            owners.clear(), counts.clear(), [x.clear() for x in found.values()]
            return pa.RecordBatch.from_arrays(out, names=[*keys, *names])

        now, group = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [batch.column(k) for k in keys]
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            begins = [0, *changes(held).tolist()]
            for begin, end in zip(begins, [*begins[1:], batch.num_rows]):
                key = tuple(h[begin].as_py() for h in held)
                if group is None or (begin or not all(x == y or (x != x and y != y) for x, y in zip(key, now))):
                    if group is not None:
                        put(now, group.finish())
                    now, group = key, start()
                put(now, group.feed(**{c: v[begin:end] for c, v in values.items()}))
                if sum(counts) > PIECE:
                    yield flush()
            if owners:
                yield flush()
        if group is not None:
            put(now, group.finish())
            if owners:
                yield flush()

    return rows.mapInArrow(run, schema)


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Rows where any of the columns differs from the row before; nulls are equal, and so are NaN."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        one, two = c[1:], c[:-1]
        differ = pc.fill_null(pc.not_equal(one, two), False)
        if pa.types.is_floating(c.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(two)), False))
        out |= pc.or_(differ, pc.not_equal(pc.is_null(one), pc.is_null(two))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out) + 1


class Whole:
    """A group that its kernel sees at once."""

    def __init__(self, kernel: Callable[..., list[dict] | dict]) -> None:
        self.kernel, self.pieces = kernel, []

    def feed(self, **arrays) -> None:
        self.pieces.append(arrays)

    def finish(self) -> dict | None:
        one = self.pieces[0] if len(self.pieces) == 1 else {c: np.concatenate([p[c] for p in self.pieces]) for c in self.pieces[0]}
        found = self.kernel(**one)
        if isinstance(found, dict):
            return found
        return {n: [r[n] for r in found] for n in found[0]} if found else None


def map_groups(df: DataFrame, keys: list[str], order: list[str], columns: list[str], kernel: Callable[..., list[dict] | dict], result: str) -> DataFrame:
    """Apply ``kernel(**arrays)`` to each group; arrays follow ``order``, and each returned dict is a row of ``result`` (or one dict has its columns)."""
    return stream_groups(df, keys, order, columns, lambda: Whole(kernel), result)


def detect_peaks(series: DataFrame, keys: list[str], detector: str = "derivative", minutes: float = 1 / 60, **options) -> DataFrame:
    """Peaks of each chromatogram (scan, intensity) by the derivative or the builtin detector."""
    from peakloom.kernels import peaks as P

    spotting = P.Spotting(**options) if detector == "derivative" else None

    def kernel(scan, intensity):
        rt = scan * minutes
        return P.derivative_peaks(rt, intensity, spotting) if spotting else P.builtin_peaks(rt, intensity, **options)

    return map_groups(series, keys, ["scan"], ["scan", "intensity"], kernel, PEAK)


def smooth_series(series: DataFrame, keys: list[str], how: str, **options) -> DataFrame:
    """Each chromatogram smoothed; returns keys, scan and smooth."""
    from peakloom.kernels.peaks import smooth

    def kernel(scan, intensity):
        return [{"scan": int(s), "smooth": float(v)} for s, v in zip(scan, smooth(intensity, how, **options))]

    return map_groups(series, keys, ["scan"], ["scan", "intensity"], kernel, "scan long, smooth double")


def fill_gaps(series: DataFrame, targets: DataFrame, keys: list[str], tolerance: float, noise: float, minutes: float = 1 / 60) -> DataFrame:
    """Integrate each chromatogram around its targets (``keys``, ``centre``); returns keys, centre and the fill."""
    from peakloom.kernels.peaks import fill_gap

    def kernel(scan, intensity, goal):
        return [fill_gap(scan * minutes, intensity, float(goal[0]), tolerance, noise)]

    joined = series.join(targets, keys).withColumn("goal", F.col("centre"))
    result = "status string, height double, area double, apex long, left long, right long, sn double, forced boolean"
    return map_groups(joined, [*keys, "centre"], ["scan"], ["scan", "intensity", "goal"], kernel, result)


def near_blocks(features: DataFrame, keys: list[str], mz_tolerance: float, rt_tolerance: float, apart: tuple[str, ...] = ()) -> DataFrame:
    """Add ``block``: features that chains of pairs within both tolerances link. ``apart`` columns tell equal ids apart."""
    own = F.xxhash64("id", *apart) if apart else F.col("id")
    return graph.near_blocks(features, F.xxhash64(*keys, own), keys, "mz", "rt", mz_tolerance, rt_tolerance)


def isotope_envelopes(features: DataFrame, base: float = 0.01, rt_tolerance: float = 0.06) -> DataFrame:
    """(sample, id, mono, step) of the members of isotope envelopes; a sample is walked once from low to high m/z, holding the masses that a walk can reach."""
    from peakloom.kernels.sweeps import EnvelopeWalk

    return stream_groups(features, ["sample"], ["mz", "id"], ["id", "mz", "rt", "height"], lambda: EnvelopeWalk(base, rt_tolerance), "id long, mono long, step long", ranged=True)


def proximity_dedup(features: DataFrame, ppm: float = 20.0, rt_tolerance: float = 0.05) -> DataFrame:
    """(sample, id) of the features that stay; blocks are chains of close pairs."""
    from peakloom.kernels.clusters import proximity_dedup as dedup

    def kernel(id, mz, rt, height):
        return [{"id": int(i)} for i in id[dedup(mz, rt, height, ppm, rt_tolerance)]]

    one = features.select(F.xxhash64("sample", "id").alias("a"), F.col("sample").alias("sample_a"), F.col("mz").alias("mz_a"), F.col("rt").alias("rt_a"), F.greatest(F.col("mz") * ppm * 1e-6, F.lit(0.005)).alias("wide"))
    two = features.select(F.xxhash64("sample", "id").alias("b"), F.col("sample").alias("sample_b"), F.col("mz").alias("mz_b"), F.col("rt").alias("rt_b"))
    pairs = box_join(two, one, [("mz_b", "mz_a", F.col("wide")), ("rt_b", "rt_a", rt_tolerance)], [("sample_a", "sample_b")], widths=[0.05, 4 * rt_tolerance])
    edges = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = linked_blocks(features, F.xxhash64("sample", "id"), edges)
    return map_groups(rows, ["sample", "block"], ["mz", "id"], ["id", "mz", "rt", "height"], kernel, "id long").drop("block")


def cluster_peaks(peaks: DataFrame, keys: list[str], tolerance: float = 0.02, span: float = 0.05) -> DataFrame:
    """Cluster number of each peak (id, apex, left, right, mz, height), -1 where a stronger one stands for it."""
    from peakloom.kernels.clusters import cluster_by_rt

    def kernel(id, apex, left, right, mz, height):
        return {"id": id, "cluster": cluster_by_rt(apex, left, right, mz, height, tolerance, span)}

    return map_groups(peaks, keys, ["apex", "id"], ["id", "apex", "left", "right", "mz", "height"], kernel, "id long, cluster long")


def rt_groups(features: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Running-median RT group of each feature."""
    from peakloom.kernels.clusters import running_median_groups

    def kernel(id, rt):
        return {"id": id, "rt_group": running_median_groups(rt, tolerance)}

    return map_groups(features, keys, ["rt", "id"], ["id", "rt"], kernel, "id long, rt_group long")


def merge_redundant(features: DataFrame, mz_gate: float, rt_gate: float) -> DataFrame:
    """(route, id, redundant): best score first, each feature claims a slot unless one within both gates is taken."""

    def kernel(id, mz, rt, height):
        taken, out = [], []
        for i in np.lexsort((id, -height)).tolist():
            hit = any(abs(mz[i] - mz[j]) < mz_gate and abs(rt[i] - rt[j]) < rt_gate for j in taken)
            if not hit:
                taken.append(i)
            out.append({"id": int(id[i]), "redundant": hit})
        return out

    return map_groups(near_blocks(features, ["route"], mz_gate, rt_gate), ["route", "block"], ["mz", "id"], ["id", "mz", "rt", "height"], kernel, "id long, redundant boolean").drop("block")
