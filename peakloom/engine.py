"""The whole run: raw files to features per sample, spots across samples, annotation and export.

Samples are checkpoints: their features are written with a fingerprint of the settings and files that they depend on, and a
rerun makes only those whose fingerprint has changed. What follows (spots, hits, tables) is made again from the stored
features, so other settings or another library cost no detection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom import stages
from peakloom.operators import alignment, relations, spectra
from peakloom.session import materialize
from peakloom.sinks import export
from peakloom.sources import checkpoints, mzml


@dataclass(frozen=True)
class Config:
    """Settings of a run; those in ``LATE`` are read after the checkpoint only."""

    width: float = 0.1
    amplitude: float = 500.0
    relaxed_amplitude: float = 50.0
    product_width: float = 0.02
    product_amplitude: float = 200.0
    least_fragments: int = 2
    least_base: float = 1000.0
    assign_rt: float = 0.05
    mode: str = "positive"
    mz_tolerance: float = 0.02
    rt_tolerance: float = 0.2
    library_tolerance: float = 0.5
    score_floor: float = 0.7


LATE = frozenset({"mz_tolerance", "rt_tolerance", "library_tolerance", "score_floor"})


class Cancelled(RuntimeError):
    """Raised between stages when the caller asks to stop; what is checkpointed stays."""


def list_files(spark: SparkSession, raw: str, groups: DataFrame | None = None) -> DataFrame:
    """sample, path, length and modificationTime of the raw files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mz[Mm][Ll]").load(raw).select("path", "length", "modificationTime")
    return files.join(mzml.group_files(files, groups).select("path", "sample"), "path")


def sample_features(points: DataFrame, config: Config = Config()) -> DataFrame:
    """Marked features of samples: sample, id, route, mz, rt, rt_left, rt_right, height, mz_source, signal_type, peaks and the marks.

    ``points`` has sample, scan, rt, ms_level, window, mz and intensity. Features are found on product scans and get a mass from the survey scans or by
    inference; survey features that none of them took follow with their own mass. No feature is dropped by a mark.
    """
    survey_points = materialize(points.where("ms_level = 1").select(F.col("sample").alias("run"), "scan", "rt", "mz", "intensity"), "survey-points")
    product_points = points.where("ms_level = 2").select("sample", F.col("window").alias("channel"), "scan", "rt", "mz", "intensity")
    axis = survey_points.select("run", "scan", "rt").distinct()

    def peaks(amplitude: float) -> DataFrame:
        found = stages.find_features(survey_points, axis, config.width, amplitude)
        found = found.select("sample", F.floor("mz").alias("channel"), "id", "mz", "rt", F.col("rt_left").alias("left"), F.col("rt_right").alias("right"), "height")
        return materialize(found, "survey-peaks")

    strict, relaxed = peaks(config.amplitude), peaks(config.relaxed_amplitude)
    products, ions = stages.detect_from_products(product_points, config.product_width, config.product_amplitude, least_fragments=config.least_fragments, least_base=config.least_base)
    products = products.withColumn("channel", F.col("channel").cast("long"))
    assigned = materialize(stages.assign_survey(products, strict, relaxed, survey_points.withColumnRenamed("run", "sample"), config.assign_rt), "assigned")
    told = materialize(stages.infer_masses(assigned, ions), "inferred")
    route = F.when(F.col("signal_type") == "ms1_detected", "MS1").otherwise("PRODUCT")
    mz = F.coalesce("survey_mz", "inferred_mz", F.col("channel").cast("double"))
    driven = told.select("sample", "id", route.alias("route"), mz.alias("mz"), "rt", F.col("left").alias("rt_left"), F.col("right").alias("rt_right"), F.coalesce("survey_height", "height").alias("height"), "mz_source", "signal_type")
    seen = told.where("signal_type = 'ms1_detected'").select("sample", F.col("survey_mz").alias("mz_t"), F.col("rt").alias("rt_t"))
    alone = relations.box_join(strict, seen.withColumnRenamed("sample", "sample_t"), [("mz", "mz_t", config.mz_tolerance), ("rt", "rt_t", config.assign_rt * 1.5)], [("sample", "sample_t")], "left_anti")
    alone = alone.select("sample", "id", F.lit("MS1").alias("route"), "mz", "rt", F.col("left").alias("rt_left"), F.col("right").alias("rt_right"), "height", F.lit("ms1").alias("mz_source"), F.lit("ms1_detected").alias("signal_type"))
    arrays = spectra.to_arrays(ions.select("id", "mz", "intensity"), ["id"])
    every = materialize(driven.unionByName(alone).join(arrays, "id", "left"), "candidates")
    return stages.mark_relations(every, mode=config.mode)


def detect(spark: SparkSession, raw: str, work: str, config: Config = Config(), groups: DataFrame | None = None) -> DataFrame:
    """The stored features of all samples, after making those that are missing or stale."""
    files = list_files(spark, raw, groups)
    prints = materialize(checkpoints.fingerprint(asdict(config), files, LATE), "fingerprints")
    todo = materialize(checkpoints.pending(prints, checkpoints.manifest(spark, work), "features").select("sample", "fingerprint"), "pending")
    paths = [r["path"] for r in files.join(todo, "sample").select("path").collect()]  # one a raw file
    if paths:
        cycles = mzml.load_cycles(mzml.read_mzml(spark, paths))
        named = mzml.long_points(cycles).join(F.broadcast(files.select("path", "sample")), "path")  # one row a raw file
        points = named.select("sample", F.col("cycle").alias("scan"), "rt", "ms_level", "window", "mz", "intensity")
        checkpoints.save(sample_features(materialize(points, "points"), config), todo, work, "features")
    return checkpoints.load(spark, work, "features").withColumn("sample", F.col("sample").cast("string")).join(prints.select("sample"), "sample", "left_semi")


def finish(features: DataFrame, config: Config = Config(), library: DataFrame | None = None) -> dict[str, DataFrame]:
    """spots, members, cells and, with a library (spec_id, precursor, peaks, and name), hits of the stored features."""
    standing = materialize(features.where("NOT is_duplicate"), "standing")
    spots, members = stages.build_spots(standing, config.mz_tolerance, config.rt_tolerance)
    spots, members = materialize(spots, "spots"), materialize(members, "members")
    seated = members.where("status = 'seated'")
    cells = seated.groupBy("spot", "sample").agg(F.max("height").alias("height"), F.max("height").alias("area"), F.lit("detected").alias("status"))
    out = {"spots": spots, "members": members, "cells": cells.join(spots.select("spot", "feature_id"), "spot").drop("spot")}
    if library is not None:
        best = alignment.Window.partitionBy("spot").orderBy(F.desc("height"), "sample", "id")
        queries = seated.where(F.size("peaks") > 0).withColumn("__n", F.row_number().over(best)).where("__n = 1").select(F.col("spot").alias("spec_id"), F.col("mz").alias("precursor"), "peaks")
        out["hits"] = materialize(stages.annotate_spots(spots, queries, library, config.library_tolerance), "hits")
    return out


def run(spark: SparkSession, raw: str, work: str, config: Config = Config(), library: DataFrame | None = None, groups: DataFrame | None = None, progress: Callable[[str], bool | None] = lambda stage: None) -> dict[str, DataFrame]:
    """Files to exported tables under ``work``; ``progress`` hears of each stage and stops the run by returning False."""

    def step(stage: str) -> None:
        if progress(stage) is False:
            raise Cancelled(stage)

    step("detect")
    features = detect(spark, raw, work, config, groups)
    step("align")
    out = {"features": features} | finish(features, config, library)
    step("export")
    heads = out["spots"].select("feature_id", "mz", "rt", "n_detected", "detection_rate")
    export.write_table(export.feature_matrix(heads, out["cells"]), f"{work}/features.csv")
    first = out["members"].where("status = 'seated'").groupBy("spot").agg(F.max_by("peaks", F.size("peaks")).alias("peaks"))
    named = out["spots"].join(first, "spot").where("peaks IS NOT NULL").select("feature_id", "mz", "rt", "peaks")
    for form in ("mgf", "msp"):
        export.write_spectra(named, f"{work}/spectra.{form}", form)
    return out


def reannotate(spark: SparkSession, work: str, library: DataFrame, config: Config = Config()) -> DataFrame:
    """Hits of the stored features in another library, without detection."""
    features = checkpoints.load(spark, work, "features").withColumn("sample", F.col("sample").cast("string"))
    return finish(features, config, library)["hits"]
