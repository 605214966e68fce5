"""Spots across samples: numbering, statistics, reference choice, audits and order-dependent assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.session import materialize


def number_rows(rows: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """Number all rows from 0 in a total order without a single-partition window.

    Rows are range-partitioned by the order; each partition is numbered on its own and starts at the
    count of those before it. The counts are one row a partition.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + inside).drop("__part", "__start")


def dedup_names(features: DataFrame, score: str) -> DataFrame:
    """The best feature of a name (letter case and outer blanks aside) keeps it, the others become putative."""
    best = F.row_number().over(Window.partitionBy(F.lower(F.trim("name"))).orderBy(F.desc(score), "id")) == 1
    return features.withColumn("name", F.when(best, F.col("name")).otherwise(F.concat(F.lit("Putative: "), F.col("name"))))


def spot_statistics(peaks: DataFrame, samples: int | Column) -> DataFrame:
    """Per spot over its detected peaks: mean of positive heights, variation, number and rate of samples."""
    seen = F.col("status") == "detected"
    positive = F.when(seen & (F.col("height") > 0), F.col("height"))
    mean = F.avg(positive)
    return peaks.groupBy("spot").agg(
        F.coalesce(mean, F.lit(0.0)).alias("mean_height"), F.when((F.count(positive) >= 2) & (mean > 0), F.stddev_pop(positive) / mean).otherwise(0.0).alias("cv"),
        F.count_distinct(F.when(seen, F.col("sample"))).alias("n_detected"), (F.count_distinct(F.when(seen, F.col("sample"))) / samples).alias("detection_rate"),
    )


def reference_sample(peaks: DataFrame, least_sn: float = 3.0) -> DataFrame:
    """The sample with most peaks above the S/N floor, then the higher mean S/N, then more peaks, then the first name."""
    stats = peaks.groupBy("sample").agg(F.count_if(F.col("sn") >= least_sn).alias("good"), F.round(F.avg("sn"), 6).alias("mean_sn"), F.count("*").alias("n"))
    order = Window.orderBy(F.desc("good"), F.desc("mean_sn"), F.desc("n"), "sample")
    return stats.withColumn("place", F.row_number().over(order))  # one row a sample


def spot_centres(peaks: DataFrame) -> DataFrame:
    """Mean RT of each spot and the m/z of its tallest peak, the smaller id on ties."""
    return peaks.groupBy("spot").agg(F.avg("rt").alias("rt"), F.max_by("mz", F.struct("height", -F.col("id"))).alias("mz"))


def namespace_groups(features: DataFrame, group: str, stride: int = 1_000_000) -> DataFrame:
    """Group ids made unique across samples: the sample's ordinal times ``stride`` plus the id; ids beyond it raise."""
    samples = features.select("sample").distinct().withColumn("__ordinal", F.dense_rank().over(Window.orderBy("sample")) - 1)
    checked = F.when((F.col(group) < 0) | (F.col(group) >= stride), F.raise_error(F.concat(F.lit("group id out of range: "), F.col(group).cast("string")))).otherwise(F.col(group))
    return features.join(F.broadcast(samples), "sample").withColumn("global_group", F.col("__ordinal") * stride + checked).drop("__ordinal")


def conservation(inputs: DataFrame, assigned: DataFrame, folded: DataFrame) -> DataFrame:
    """Counts of (sample, id) that came in, were seated or folded, and of those neither; with a digest of the seats."""
    keys = ["sample", "id"]
    lost = inputs.join(assigned.select(*keys), keys, "left_anti").join(folded.select(*keys), keys, "left_anti").agg(F.count("*").alias("n_lost"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(inputs, "n_input").crossJoin(n(assigned, "n_assigned")).crossJoin(n(folded, "n_folded")).crossJoin(lost)  # one row each


def membership_digests(peaks: DataFrame) -> DataFrame:
    """SHA-256 of each spot's sorted members, written sample:id and joined by commas."""
    member = F.concat_ws(":", "sample", F.col("id").cast("string"))
    return peaks.groupBy("spot").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(member)), ",").cast("binary"), 256).alias("digest"), F.count("*").alias("members"))


def pivot_samples(peaks: DataFrame, samples: list[str]) -> DataFrame:
    """One row a spot with its greatest height in each sample, 0 where it has none."""
    return peaks.groupBy("spot").agg(*[F.coalesce(F.max(F.when(F.col("sample") == s, F.col("height"))), F.lit(0.0)).alias(f"height_{k}") for k, s in enumerate(samples)])


def align_samples(features: DataFrame, reference: str | None = None, mz_tolerance: float = 0.02, rt_tolerance: float = 0.2) -> DataFrame:
    """Spots across samples: (sample, id, spot, status, holder).

    ``features`` has sample, id, route, mz, rt, height and may have peaks. The sample order is global (the reference
    first, then by name) and travels as a column; blocks are features of a route that chains of boxes link,
    so no box reaches beyond its block. Every feature is seated in a spot or folded into a holder with SAME spectra.
    """
    from peakloom.kernels.align import Block
    from peakloom.operators.kernelled import map_groups, near_blocks

    names = features.select("sample").distinct()
    order = names.withColumn("rank", F.row_number().over(Window.orderBy(F.col("sample") != F.lit(reference or ""), "sample")) - 1)
    rows = near_blocks(features.join(F.broadcast(order), "sample"), ["route"], mz_tolerance, rt_tolerance, ("sample",))  # one row a sample
    spectra = "peaks" in features.columns
    if spectra:
        none = F.array().cast("array<double>")  # a feature without a spectrum
        rows = rows.withColumns({"ions": F.coalesce(F.transform("peaks", lambda p: p["mz"]), none), "heights": F.coalesce(F.transform("peaks", lambda p: p["intensity"]), none)})

    def kernel(rank, id, mz, rt, height, ions=None, heights=None):
        found = Block(rank, id, mz, rt, height, ions, heights, mz_tolerance, rt_tolerance).align()
        return [{"rank": int(rank[i]), "id": int(id[i]), "spot": int(id[s]), "spot_rank": int(rank[s]), "status": status, "holder": int(id[h])} for i, s, status, h in found]

    columns = ["rank", "id", "mz", "rt", "height", *(["ions", "heights"] if spectra else [])]
    out = map_groups(rows, ["route", "block"], ["mz", "rank", "id"], columns, kernel, "rank long, id long, spot long, spot_rank long, status string, holder long")
    return out.join(F.broadcast(order), "rank").select("sample", "id", "route", "spot", "spot_rank", "status", "holder")


def align_to_reference(features: DataFrame, reference: str, mz_tolerance: float, rt_tolerance: float) -> DataFrame:
    """(sample, id, match, score): the assignment of greatest total score of each sample's features to the reference's.

    Pairs within three tolerances link features to blocks; only candidate pairs meet, in a group for each sample and block.
    """
    from peakloom.kernels.align import align_pair
    from peakloom.operators.kernelled import map_groups
    from peakloom.plans.bands import box_join
    from peakloom.plans.graph import linked_blocks

    base = features.where(F.col("sample") == reference).select(F.col("id").alias("match"), F.col("mz").alias("mz_r"), F.col("rt").alias("rt_r"))
    others = features.where(F.col("sample") != reference).select("sample", "id", "mz", "rt")
    pairs = materialize(box_join(others, base, [("mz", "mz_r", 3 * mz_tolerance), ("rt", "rt_r", 3 * rt_tolerance)]), "reference-pairs")
    edges = pairs.select(F.xxhash64("sample", F.lit(0), "id").alias("a"), F.xxhash64("sample", F.lit(1), "match").alias("b"))

    def kernel(id, mz, rt, match, mz_r, rt_r):
        (_, mine), (_, theirs) = np.unique(id, return_index=True), np.unique(match, return_index=True)
        found = align_pair((mz_r[theirs], rt_r[theirs]), (mz[mine], rt[mine]), mz_tolerance, rt_tolerance)
        return [{"id": int(id[mine[j]]), "match": int(match[theirs[i]]), "score": s} for i, j, s in found]

    rows = linked_blocks(pairs, F.xxhash64("sample", F.lit(0), "id"), edges)
    columns = ["id", "mz", "rt", "match", "mz_r", "rt_r"]
    return map_groups(rows, ["sample", "block"], ["id", "match"], columns, kernel, "id long, match long, score double").drop("block")


def reconcile_spots(spots: DataFrame, mz_gate: float, rt_gate: float) -> DataFrame:
    """(route, spot, merged): complete-link merging of spots whose samples are disjoint, by blocks of spots within the gates.

    ``spots`` has route, spot, mz, rt, weight and samples (array).
    """
    from peakloom.kernels.align import reconcile
    from peakloom.operators.kernelled import map_groups, near_blocks

    def kernel(id, mz, rt, weight, samples):
        found = reconcile(mz, rt, weight, [frozenset(s) for s in samples], mz_gate, rt_gate)
        return [{"spot": int(a), "merged": int(id[m])} for a, m in zip(id, found)]

    rows = near_blocks(spots.withColumnRenamed("spot", "id"), ["route"], mz_gate, rt_gate)
    return map_groups(rows, ["route", "block"], ["mz", "id"], ["id", "mz", "rt", "weight", "samples"], kernel, "spot long, merged long").select("route", "spot", "merged")


def exclusive_assignment(features: DataFrame, peaks: DataFrame, rt_tolerance: float, weight: float = 0.3) -> DataFrame:
    """(sample, channel, id, peak): best-first 1:1 assignment of MS1 peaks to features by RT and overlap, per channel.

    Both sides have sample, channel, id, rt, left, right. Pairs are scored where both sides of a channel meet in order of RT, and none is written.
    """
    from peakloom.kernels.sweeps import Assignment
    from peakloom.operators.kernelled import stream_groups

    side = lambda df, k: df.select("sample", "channel", F.lit(k).alias("side"), "id", *[F.col(c).cast("double").alias(c) for c in ("rt", "left", "right")])
    rows = side(features, 0).unionByName(side(peaks, 1)).where("sample IS NOT NULL AND channel IS NOT NULL AND abs(rt) < double('Infinity')")
    columns = ["side", "id", "rt", "left", "right"]
    return stream_groups(rows, ["sample", "channel"], ["rt", "side", "id"], columns, lambda: Assignment(rt_tolerance, weight), "id long, peak long")


def routed_segment(spots: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment of each spot: by its name, else the first that covers its m/z (low to high + 1)."""
    named = spots.join(segments.select("segment", F.lit(True).alias("exact")), "segment", "left")
    ranges = segments.select(F.col("segment").alias("by_range"), F.explode(F.sequence(F.col("low").cast("long"), F.col("high").cast("long") + 1)).alias("cell"), "low", "high")
    hits = named.where("exact IS NULL").join(ranges, F.floor("mz") == F.col("cell")).where("mz BETWEEN low AND high + 1")
    first = hits.groupBy("spot").agg(F.min(F.struct("low", "by_range"))["by_range"].alias("by_range"))
    return named.join(first, "spot", "left").select("spot", F.when(F.col("exact"), F.col("segment")).otherwise(F.col("by_range")).alias("segment"))


def reused_fills(fills: DataFrame, natural: DataFrame, mz_tolerance: float) -> DataFrame:
    """Fills (spot, sample, mz, apex, left, right) that rest on a natural peak of another spot: apexes inside each other's bounds."""
    from peakloom.plans.bands import band_join

    other = natural.select(*[F.col(c).alias(f"{c}_n") for c in ("spot", "sample", "mz", "apex", "left", "right")])
    pairs = band_join(fills, other, "mz", "mz_n", mz_tolerance, [("sample", "sample_n")])
    inside = F.col("apex").between(F.col("left_n"), F.col("right_n")) & F.col("apex_n").between(F.col("left"), F.col("right"))
    return pairs.where((F.col("spot") != F.col("spot_n")) & inside).select("spot", "sample").distinct()


def rematch_notes(notes: DataFrame, features: DataFrame, ppm: float = 5.0, least: float = 0.001, rt_tolerance: float = 0.05) -> DataFrame:
    """(note, state, id): exact id first, else the only feature within the tolerances (auto), several (ambiguous) or none (orphan)."""
    from peakloom.plans.bands import band_join

    exact = notes.join(features.select(F.col("id").alias("feature")), "feature", "left_semi")
    rest = notes.join(exact.select("note"), "note", "left_anti")
    other = features.select(F.col("id").alias("hit"), F.col("rt").alias("rt_f"), F.col("mz").alias("mz_f"))
    pairs = band_join(rest, other, "rt", "rt_f", rt_tolerance).where(F.abs(F.col("mz") - F.col("mz_f")) <= F.greatest(F.col("mz") * ppm * 1e-6, F.lit(least)))
    found = pairs.groupBy("note").agg(F.count("*").alias("n"), F.min("hit").alias("hit"))
    state = F.when(F.col("n") == 1, "auto").when(F.col("n") > 1, "ambiguous").otherwise("orphan")
    told = rest.join(found, "note", "left").select("note", state.alias("state"), F.when(F.col("n") == 1, F.col("hit")).alias("id"))
    return exact.select("note", F.lit("exact").alias("state"), F.col("feature").alias("id")).unionByName(told)


def alias_edges(left: DataFrame, right: DataFrame, mz_tolerance: float, rt_tolerance: float, ratio: float = 0.8) -> DataFrame:
    """(a, b): two views of one peak of a sample, close in m/z and RT and alike in height."""
    from peakloom.plans.bands import box_join

    other = right.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "sample", "mz", "rt", "height")])
    pairs = box_join(left, other, [("mz", "mz_b", mz_tolerance), ("rt", "rt_b", rt_tolerance)], [("sample", "sample_b")])
    alike = F.least("height", "height_b") / F.greatest("height", "height_b") >= ratio
    return pairs.where(alike).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def covered_rows(product: DataFrame, survey: DataFrame, rt_gate: float, least: float) -> DataFrame:
    """(id, cover, score): for each product row the survey row at its time whose spectrum is most like its own, the smaller id on ties.

    Both sides have sample, id, rt and peaks; only pairs at the same time and in the same sample are scored.
    """
    from peakloom.kernels.similarity import cosine
    from peakloom.operators.spectra import score_pairs
    from peakloom.plans.bands import band_join, box_join

    tolerance = 0.02
    other = survey.select(F.col("id").alias("cover"), F.col("sample").alias("sample_c"), F.col("rt").alias("rt_c"), F.col("peaks").alias("peaks_b"))
    mine = product.withColumnRenamed("peaks", "peaks_a")
    if least > 0:  # only pairs that share an ion score above 0, so pairs are found by their ions, and spectra follow
        ions = lambda df, peaks, name: df.withColumn(name, F.explode(F.array_distinct(F.transform(peaks, lambda p: p["mz"])))).drop(peaks)
        left = ions(mine.select("sample", "id", "rt", "peaks_a"), "peaks_a", "ion")
        met = box_join(left, ions(other, "peaks_b", "ion_c"), [("ion", "ion_c", tolerance), ("rt", "rt_c", rt_gate)], [("sample", "sample_c")])
        met = met.where(F.abs(F.col("rt") - F.col("rt_c")) < rt_gate).select("sample", "id", "cover").distinct()
        pairs = met.join(mine.select("sample", "id", "peaks_a"), ["sample", "id"]).join(other.select(F.col("sample_c").alias("sample"), "cover", "peaks_b"), ["sample", "cover"])
    else:
        pairs = band_join(mine, other, "rt", "rt_c", rt_gate, [("sample", "sample_c")]).where(F.abs(F.col("rt") - F.col("rt_c")) < rt_gate)
    scored = score_pairs(pairs, lambda ma, ia, mb, ib: {"score": cosine(ma, ia, mb, ib, tolerance)[0]}, "score double", ["id", "cover"]).where(F.col("score") >= least)
    return scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("cover")).alias("back"))).alias("x")).select("id", (-F.col("x.back")).alias("cover"), "x.score")
