"""Spectra: long form (one row a peak) for relational steps, arrays for scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PEAKS = "array<struct<mz:double,intensity:double>>"


def to_arrays(spectra: DataFrame, keys: list[str], name: str = "peaks") -> DataFrame:
    """One row a spectrum: its peaks as an array ordered by (m/z, intensity)."""
    return spectra.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias(name))


def arrays_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(m/z, intensity) of each row of a list column of peaks, as views of the flat children."""
    flat = column.flatten()
    mz, intensity = (np.asarray(flat.field(n)) for n in ("mz", "intensity"))
    ends = np.cumsum([len(x) if x is not None else 0 for x in column])
    return [(mz[b - n : b], intensity[b - n : b]) for b, n in zip(ends.tolist(), np.diff(np.r_[0, ends]).tolist())]


def score_pairs(pairs: DataFrame, kernel: Callable[..., dict], schema: str, keep: list[str], extra: list[str] | None = None) -> DataFrame:
    """Apply ``kernel(mz_a, int_a, mz_b, int_b, *extra)`` to rows with array columns ``peaks_a`` and ``peaks_b``.

    Both arrays travel in one row; scores return as columns of ``schema`` beside ``keep``.
    """
    extra = extra or []
    narrow = pairs.select(*keep, *[c for c in extra if c not in keep], "peaks_a", "peaks_b")
    out = narrow.select(*keep).schema
    for f in pairs.sparkSession.createDataFrame([], schema).schema:
        out = out.add(f)
    names = [f.name for f in out if f.name not in keep]

    def run(batches):
        for batch in batches:
            a, b = arrays_of(batch.column("peaks_a")), arrays_of(batch.column("peaks_b"))
            more = [batch.column(c).to_pylist() for c in extra]
            rows = [kernel(*x, *y, *z) for x, y, *z in zip(a, b, *more)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([r[n] for r in rows]) for n in names)], names=[*keep, *names])

    return narrow.mapInArrow(run, out)


def drop_flat_noise(spectra: DataFrame, keys: list[str], times: int = 3) -> DataFrame:
    """Peaks whose intensity occurs fewer than ``times`` times in their spectrum."""
    return spectra.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "intensity"))).where(F.col("__n") < times).drop("__n")


def intensity_floor(spectra: DataFrame, keys: list[str], least: float, share: float) -> DataFrame:
    """Peaks of at least ``least`` and of at least ``share`` of their spectrum's base peak."""
    top = F.max("intensity").over(Window.partitionBy(*keys))
    return spectra.withColumn("__top", top).where((F.col("intensity") >= least) & (F.col("intensity") >= F.col("__top") * share)).drop("__top")


def before_precursor(spectra: DataFrame, precursor: str, beyond: float = 1.5) -> DataFrame:
    """Peaks up to ``beyond`` above the precursor."""
    return spectra.where(F.col("mz") <= F.col(precursor) + beyond)


def keep_top(spectra: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` strongest peaks of each spectrum, ties by m/z."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("intensity"), "mz"))
    return spectra.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def representative_ion(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """m/z of the strongest peak of each spectrum, the larger m/z on ties."""
    return spectra.groupBy(*keys).agg(F.max(F.struct("intensity", "mz"))["mz"].alias("rep_mz"))


def representative_mz(spectra: DataFrame, keys: list[str], flagged: Column, share: float = 0.05) -> DataFrame:
    """The heaviest unflagged ion of at least ``share`` of the base; else the heaviest unflagged; else the heaviest strong one; else the heaviest."""
    top = spectra.withColumns({"__top": F.max("intensity").over(Window.partitionBy(*keys)), "__bad": flagged})
    strong, clean = F.col("intensity") >= F.col("__top") * share, ~F.col("__bad")
    heaviest = lambda test: F.max(F.when(test, F.col("mz")))
    return top.groupBy(*keys).agg(F.coalesce(heaviest(strong & clean), heaviest(clean), heaviest(strong), F.max("mz")).alias("rep_mz"))


def fixed(value: Column, places: int) -> Column:
    """The double with so many decimals as C prints it: its exact binary value rounded, halves to even.

    ``format_string`` rounds the shortest decimal form instead, halves up. The product with the power of ten and its rounding error are
    split exactly (Dekker); beyond 2^52, where doubles are whole, and for what is not finite the plain format stays.
    """
    power = float(10**places)
    x = F.abs(value)
    spread = x * 134217729.0
    high = spread - (spread - x)
    scaled = x * power
    error = (high * power - scaled) + (x - high) * power
    floor = F.floor(scaled)
    over = (scaled - floor.cast("double") - 0.5) + error
    n = floor + F.when((over > 0) | ((over == 0) & (floor % 2 == 1)), 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    if places:
        digits = F.lpad(n.cast("string"), 20, "0")
        body = F.concat(((n - n % int(power)) / power).cast("long").cast("string"), F.lit("."), F.substring(digits, 21 - places, places))
    else:
        body = n.cast("string")
    return F.when(scaled < 4503599627370496.0, F.concat(sign, body)).otherwise(F.format_string(f"%.{places}f", value))


def joined(peaks: Column, form: str, separator: str) -> Column:
    """The peaks as text; ``form`` has one %.nf for the m/z and one for the intensity, printed as C does (as ``fixed``, but for all peaks of a batch)."""

    def told(mz, intensity) -> str | None:
        if mz is None or intensity is None:
            return None
        text = form % (mz + 0.0, intensity + 0.0)
        return text if np.isfinite(mz) and np.isfinite(intensity) else text.replace("inf", "Infinity").replace("nan", "NaN")

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        mz, intensity = flat.field("mz"), flat.field("intensity")
        if flat.null_count or mz.null_count or intensity.null_count:
            texts = [None if r is None else told(r["mz"], r["intensity"]) for r in flat.to_pylist()]
        else:
            mz, intensity = np.asarray(mz) + 0.0, np.asarray(intensity) + 0.0
            plain = np.isfinite(mz).all() and np.isfinite(intensity).all()
            texts = [form % p for p in zip(mz.tolist(), intensity.tolist())] if plain else [told(*p) for p in zip(mz.tolist(), intensity.tolist())]
        out, begin = [], 0
        for n in pc.list_value_length(column).to_pylist():
            out.append(None if n is None else separator.join(t for t in texts[begin : begin + n] if t is not None))
            begin += n or 0
        return pa.array(out, pa.string())

    return run(peaks)


def msp_record(name: Column, precursor: Column, rt: Column, peaks: Column) -> Column:
    """One record of an MSP file."""
    head = F.concat_ws("\n", F.concat(F.lit("NAME: "), name), F.concat(F.lit("PRECURSORMZ: "), fixed(precursor, 5)), F.concat(F.lit("RETENTIONTIME: "), fixed(rt, 7)), F.format_string("Num Peaks: %d", F.size(peaks)))
    return F.concat(head, F.lit("\n"), joined(peaks, "%.5f\t%.0f", "\n"), F.lit("\n"))


def mgf_record(title: Column, precursor: Column, rt_minutes: Column, peaks: Column) -> Column:
    """One record of an MGF file; retention times are written in seconds."""
    head = F.concat_ws("\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), title), F.concat(F.lit("PEPMASS="), fixed(precursor, 5)), F.concat(F.lit("RTINSECONDS="), fixed(rt_minutes * 60, 1)))
    return F.concat(head, F.lit("\n"), joined(peaks, "%.5f %.1f", "\n"), F.lit("\nEND IONS\n"))


def clean_spectra(spectra: DataFrame, keys: list[str], precursor: str, **options) -> DataFrame:
    """The whole clean-up chain (merge, flat noise, floor, precursor, top) on arrays; returns long form."""
    from peakloom.kernels.similarity import clean

    arrays = to_arrays(spectra, [*keys, precursor])
    schema = arrays.select(*keys).schema.add("mz", "double").add("intensity", "double")

    def run(batches):
        for batch in batches:
            found = [clean(mz, x, p, **options) for (mz, x), p in zip(arrays_of(batch.column("peaks")), batch.column(precursor).to_pylist())]
            at = pa.array(np.repeat(np.arange(len(found)), [len(m) for m, _ in found]))
            flat = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *map(pa.array, flat)], names=[*keys, "mz", "intensity"])

    return arrays.mapInArrow(run, schema)
