"""Filters, statistics and tables of features and spots that take one aggregation or window each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators.alignment import number_rows


def enough_scans(points: DataFrame, keys: Sequence[str | Column], least: int) -> DataFrame:
    """Series (``keys``) with signal in at least ``least`` scans, and in how many."""
    return points.where("intensity > 0").groupBy(*keys).agg(F.count_distinct("scan").alias("scans")).where(F.col("scans") >= least)


def in_rt_window(features: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Features whose apex lies in the window, both ends included; None leaves an end open."""
    kept = features if low is None else features.where(F.col("rt") >= low)
    return kept if high is None else kept.where(F.col("rt") <= high)


def display_rows(features: DataFrame, order: list[Column], hide: Column | None = None, only: Column | None = None, text: str = "", columns: Sequence[str] = (), mz: float | None = None, ppm: float = 10.0) -> DataFrame:
    """The features that a table view shows, numbered from 1 in its order.

    ``hide`` leaves rows out (duplicates, say), ``only`` keeps some (those with a name, say), ``text`` is looked for in ``columns`` whatever
    the letter case, and ``mz`` keeps what is within ``ppm`` of it.
    """
    kept = features if hide is None else features.where(~F.coalesce(hide, F.lit(False)))
    kept = kept if only is None else kept.where(only)
    if text:
        kept = kept.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))
    if mz is not None:
        kept = kept.where(F.abs(F.col("mz") - mz) <= mz * ppm * 1e-6)
    return number_rows(kept, order).withColumn("place", F.col("number") + 1).drop("number")


def least_shape(features: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """The least positive shape value of each group, 0 where it has none."""
    return features.groupBy(*keys).agg(F.coalesce(F.min(F.when((value > 0) & ~F.isnan(value), value)), F.lit(0.0)).alias("gaussian"))


def scan_sharpness(ions: DataFrame, keys: Sequence[str], quality: str = "quality", classes: Sequence[str] = ("high", "middle"), value: str = "sharpness") -> DataFrame:
    """The greatest sharpness of each scan over ions of the given classes."""
    return ions.where(F.col(quality).isin(*classes)).groupBy(*keys).agg(F.max(value).alias("sharpness"))


def spot_noise(peaks: DataFrame) -> DataFrame:
    """Noise floor of each spot: the greatest height over S/N of its detected peaks."""
    return peaks.where("sn > 0 AND status = 'detected'").groupBy("spot").agg(F.max(F.col("height") / F.col("sn")).alias("noise"))


def counters(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many rows there are of each combination, such as route, status and sample."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def spot_map(peaks: DataFrame) -> DataFrame:
    """(id, spot, representative, reason): the tallest peak stands for its spot, the smaller id on ties."""
    w = Window.partitionBy("spot").orderBy(F.desc("height"), "id")
    reason = F.when(F.row_number().over(w) == 1, "representative").otherwise("member")
    return peaks.select("id", "spot", F.first("id").over(w).alias("representative"), reason.alias("reason"))


def note_rows(notes: DataFrame, key: str, tag: str, verified: Column) -> DataFrame:
    """Notes for export: the distinct tags of each key in order, joined by a bar, and whether any of its notes is verified."""
    return notes.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(tag)), "|").alias("tags"), F.max(verified).alias("verified"))


def blocked_audit(blocked: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Number of blocked fills of each group and the SHA-256 of their sorted ids joined by commas."""
    ids = F.transform(F.array_sort(F.collect_list(id_col)), lambda i: i.cast("string"))
    return blocked.groupBy(*keys).agg(F.count("*").alias("blocked"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("digest"))


def sample_sets(peaks: DataFrame) -> DataFrame:
    """Samples in which each spot is filled only, whether any is both detected and filled, and in how many it has either."""
    of = lambda s: F.collect_set(F.when(F.col("status") == s, F.col("sample")))
    sets = peaks.groupBy("spot").agg(of("detected").alias("det"), of("filled").alias("fil"))
    return sets.select("spot", F.size(F.array_except("fil", "det")).cast("long").alias("only_filled"), F.arrays_overlap("det", "fil").alias("overlap"), F.size(F.array_union("det", "fil")).cast("long").alias("every"))


def admitted(features: DataFrame, ions: DataFrame, recalled: DataFrame | None = None, cleaned: DataFrame | None = None, least_fragments: int = 2, least_base: float = 1000.0) -> DataFrame:
    """Features that have enough fragments, counting recalled ones, enough of them after the clean-up, and a base peak that is high enough.

    ``features`` has id; the ion tables have id, mz and intensity; without ``cleaned`` the ions of the cluster count as clean.
    """
    found = ions.select("id", "intensity") if recalled is None else ions.select("id", "intensity").unionByName(recalled.select("id", "intensity"))
    clean = found if cleaned is None else cleaned.select("id", "intensity")
    first = found.groupBy("id").agg(F.count("*").alias("__found"))
    second = clean.groupBy("id").agg(F.count("*").alias("__clean"), F.max("intensity").alias("__base"))
    enough = first.join(second, "id").where((F.col("__found") >= least_fragments) & (F.col("__clean") >= least_fragments) & (F.col("__base") >= least_base))
    return features.join(enough.select("id"), "id", "left_semi")
