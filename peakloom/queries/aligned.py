"""Queries on kernels, clusters and spots across samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.operators import alignment as A
from peakloom.operators import chromatogram as C
from peakloom.operators import extraction as X
from peakloom.operators import kernelled as G
from peakloom.operators import summaries as U
from peakloom.queries.base import chromatograms, features, points, query, scaled, spectra
from peakloom.session import table


@query("wn07_moving_average", "SELECT channel, scan, round(sum(intensity) OVER (PARTITION BY channel ORDER BY scan ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 5) AS smooth FROM chrom", "chrom")
def _(spark, sf_dir):
    return G.smooth_series(chromatograms(spark, sf_dir), ["channel"], "moving_average", window=5).select("channel", F.col("scan").cast("int").alias("scan"), F.round("smooth", 5).alias("smooth"))


@query("wn07_savitzky_golay", """WITH m AS (SELECT c.channel, c.scan, greatest(3, least(716, c.scan)) AS mid FROM chrom c), w AS (SELECT m.channel, m.scan, m.scan - m.mid AS z, sum(x.intensity) AS s0, sum((x.scan - m.mid) * x.intensity) AS s1,
    sum((x.scan - m.mid) * (x.scan - m.mid) * x.intensity) AS s2 FROM m JOIN chrom x ON x.channel = m.channel AND x.scan BETWEEN m.mid - 3 AND m.mid + 3 GROUP BY ALL)
    SELECT channel, CAST(scan AS BIGINT) AS scan, round(greatest(0, (7 * s0 - s2) / 21 + s1 / 28 * z + (s2 - 4 * s0) / 84 * z * z), 5) AS smooth FROM w""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    return G.smooth_series(chromatograms(spark, sf_dir), ["channel"], "savgol", window=7, order=2).select("channel", "scan", F.round("smooth", 5).alias("smooth"))


def bells(spark, sf_dir):
    """The chromatograms as a ripple on a bell every ten days, so that there are peaks to find."""
    bell = F.exp(-F.pow((F.col("scan") % 240 - 120) / 6, 2)) * 2000
    return chromatograms(spark, sf_dir).withColumn("intensity", bell + F.col("intensity") % 20)


@query("wn13_builtin_peaks")
def _(spark, sf_dir):
    return G.detect_peaks(bells(spark, sf_dir), ["channel"], "builtin", least=10.0, points=2, fold=0.0)


@query("wn14_derivative_peaks")
def _(spark, sf_dir):
    return G.detect_peaks(bells(spark, sf_dir), ["channel"], "derivative", amplitude=100.0)


def day_peaks():
    return """p AS (SELECT channel, CAST(scan // 24 AS INT) AS day, CAST(scan % 24 AS INT) AS pos, intensity FROM chrom), a AS (SELECT channel, day, arg_max(pos, {'i': intensity, 'a': -pos}) AS apex, max(intensity) AS top, min(pos) AS lo, max(pos) AS hi,
      arg_min(intensity, pos) AS first_i, arg_max(intensity, pos) AS last_i FROM p GROUP BY ALL),
      j AS (SELECT p.*, apex, top, lead(intensity) OVER (PARTITION BY p.channel, p.day ORDER BY pos) - intensity AS step, CASE WHEN pos <> apex THEN (top - intensity) / abs(pos - apex) / sqrt(top) END AS drop FROM p JOIN a USING (channel, day))"""


@query("wn16_shape_scores", f"""WITH {day_peaks()}, s AS (SELECT channel, day, max(CASE WHEN pos < apex THEN drop END) AS l, max(CASE WHEN pos > apex THEN drop END) AS r, sum(CASE WHEN pos < apex THEN greatest(step, 0) ELSE greatest(-step, 0) END) AS good, sum(CASE WHEN pos < apex THEN greatest(-step, 0) ELSE greatest(step, 0) END) AS bad
    FROM j GROUP BY ALL) SELECT channel, day, round((l + r) / 2, 5) AS shapeness, round(CASE WHEN good > 0 THEN greatest(0, (good - bad) / good) ELSE 0 END, 6) AS ideal_slope FROM s WHERE l IS NOT NULL AND r IS NOT NULL""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    p = chromatograms(spark, sf_dir).select("channel", F.floor(F.col("scan") / 24).cast("int").alias("day"), (F.col("scan") % 24).alias("at"), "intensity")
    return C.shape_scores(p, ["channel", "day"]).select("channel", "day", F.round("shapeness", 5).alias("shapeness"), scaled("ideal_slope").alias("ideal_slope"))


def _taps() -> str:
    import math

    sigma, half = 2.0, 10
    return " + ".join(f"({(1 - (k / sigma) ** 2) * math.exp(-0.5 * (k / sigma) ** 2)!r}::DOUBLE) * coalesce({'lag' if k < 0 else 'lead'}(intensity, {abs(k)}) OVER w, 0)" for k in range(-half, half + 1))


@query("wn18_matched_filter", f"SELECT channel, scan, round({_taps()}, 3) AS response FROM chrom WINDOW w AS (PARTITION BY channel ORDER BY scan)", "chrom")
def _(spark, sf_dir):
    return chromatograms(spark, sf_dir).select("channel", "scan", F.round(C.matched_filter("intensity", 2.0), 3).alias("response"))


@query("wn20_parabola_apex", """WITH x AS (SELECT channel, scan, lag(intensity) OVER w AS a, intensity AS b, lead(intensity) OVER w AS c FROM chrom WINDOW w AS (PARTITION BY channel ORDER BY scan))
    SELECT channel, scan, round(scan + greatest(-5e-1, least(5e-1, (a - c) / (2 * (a - 2 * b + c)))), 6) AS apex FROM x WHERE b > a AND b > c""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    return C.parabola_apexes(chromatograms(spark, sf_dir)).select("channel", "scan", scaled("apex").alias("apex"))


@query("wn19_gap_fill")
def _(spark, sf_dir):
    series = chromatograms(spark, sf_dir)
    targets = series.where("intensity > 0").groupBy("channel", F.floor(F.col("scan") / 24).alias("day")).agg((F.max_by("scan", F.struct("intensity", -F.col("scan"))) / 60).alias("centre")).drop("day")
    return G.fill_gaps(series, targets, ["channel"], 0.1, 50.0)


@query("cl01_rt_clusters")
def _(spark, sf_dir):
    f = features(spark, sf_dir)
    peaks = f.select("sample", F.floor(F.col("mz") / 5).alias("channel"), "id", F.col("rt").alias("apex"), (F.col("rt") - 0.05).alias("left"), (F.col("rt") + 0.05).alias("right"), "mz", "height")
    return G.cluster_peaks(peaks, ["sample", "channel"], 0.05, 0.2)


@query("cl02_rt_groups")
def _(spark, sf_dir):
    return G.rt_groups(features(spark, sf_dir).withColumn("channel", F.floor(F.col("mz") / 5)), ["sample", "channel"], 0.1)


@query("cl06_isotope_envelopes")
def _(spark, sf_dir):
    varied = features(spark, sf_dir).withColumn("height", (F.col("id") * 7919 % 10007).cast("double"))  # heights that do not rise with m/z
    return G.isotope_envelopes(varied, 0.005, 0.05)


@query("tk04_proximity_dedup")
def _(spark, sf_dir):
    return G.proximity_dedup(features(spark, sf_dir), 100.0, 1.0)


@query("tk11_slots")
def _(spark, sf_dir):
    return G.merge_redundant(features(spark, sf_dir), 0.05, 0.5)


@query("jn04_exclusive_assignment")
def _(spark, sf_dir):
    f = features(spark, sf_dir).withColumns({"channel": F.floor(F.col("mz") / 10), "left": F.col("rt") - F.col("height") % 7 / 50, "right": F.col("rt") + F.col("height") % 5 / 50})
    return A.exclusive_assignment(f.where("route = 'O'"), f.where("route = 'F'"), 0.1)


def aligned(spark, sf_dir):
    return A.align_samples(features(spark, sf_dir), None, 0.02, 0.5)


@query("jn13_align_conservation", "SELECT count(*) AS n_input, count(*) AS n_seated_or_folded, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_double FROM features", "features")
def _(spark, sf_dir):
    from peakloom.session import materialize

    f, out = features(spark, sf_dir).select("sample", "id"), materialize(aligned(spark, sf_dir), "aligned")
    audit = A.conservation(f, out.where("status = 'seated'"), out.where("status = 'folded'"))
    double = out.where("status = 'seated'").groupBy("route", "spot", "spot_rank", "sample").count().where("count > 1").agg(F.count("*").alias("n_double"))
    return audit.crossJoin(double).select("n_input", (F.col("n_assigned") + F.col("n_folded")).alias("n_seated_or_folded"), "n_lost", "n_double")


@query("jn14_aligned_spots")
def _(spark, sf_dir):
    return aligned(spark, sf_dir)


@query("jn18_reference_assignment")
def _(spark, sf_dir):
    return A.align_to_reference(features(spark, sf_dir), "1-URGENT", 0.01, 0.2)


@query("cl09_reconciled_spots")
def _(spark, sf_dir):
    spots = features(spark, sf_dir).groupBy("route", "spot").agg(F.avg("mz").alias("mz"), F.avg("rt").alias("rt"), F.count("*").cast("double").alias("weight"), F.sort_array(F.collect_set("sample")).alias("samples"))
    return A.reconcile_spots(spots, 0.05, 0.3)


# Spots of the orders: a customer is a spot, a priority a sample, a status of F detected, O filled, P no signal.
def spot_peaks(spark, sf_dir):
    status = F.when(F.col("route") == "F", "detected").when(F.col("route") == "O", "filled").otherwise("no_signal")
    return features(spark, sf_dir).withColumns({"status": status, "sn": F.round(F.col("height") / (F.col("rt") * 1000 + 1), 6)})


_SPOT = "sp AS (SELECT *, CASE route WHEN 'F' THEN 'detected' WHEN 'O' THEN 'filled' ELSE 'no_signal' END AS status, round(height / (rt * 1000 + 1), 6) AS sn FROM features)"


@query("ag13_spot_statistics", f"""WITH {_SPOT} SELECT spot, round(coalesce(avg(height) FILTER (status = 'detected' AND height > 0), 0), 5) AS mean_height, round(CASE WHEN count(*) FILTER (status = 'detected' AND height > 0) >= 2 THEN stddev_pop(height) FILTER (status = 'detected' AND height > 0) / avg(height) FILTER (status = 'detected' AND height > 0) ELSE 0 END, 6) AS cv,
    count(DISTINCT sample) FILTER (status = 'detected') AS n_detected, round(count(DISTINCT sample) FILTER (status = 'detected') / 5, 6) AS detection_rate FROM sp GROUP BY spot""", "features")  # fmt: skip
def _(spark, sf_dir):
    out = A.spot_statistics(spot_peaks(spark, sf_dir), 5)
    return out.select("spot", F.round("mean_height", 5).alias("mean_height"), scaled("cv").alias("cv"), "n_detected", scaled("detection_rate").alias("detection_rate"))


@query("ag14_reference_sample", f"WITH {_SPOT}, s AS (SELECT sample, count(*) FILTER (sn >= 20) AS good, round(avg(sn), 6) AS mean_sn, count(*) AS n FROM sp GROUP BY sample) SELECT *, row_number() OVER (ORDER BY good DESC, mean_sn DESC, n DESC, sample) AS place FROM s", "features")
def _(spark, sf_dir):
    return A.reference_sample(spot_peaks(spark, sf_dir), 20.0).withColumn("place", F.col("place").cast("long"))


@query("ag15_spot_centres", "SELECT spot, round(avg(rt), 6) AS rt, arg_max(mz, {'h': height, 'i': -id}) AS mz FROM features GROUP BY spot", "features")
def _(spark, sf_dir):
    return A.spot_centres(features(spark, sf_dir)).withColumn("rt", scaled("rt"))


@query("ag18_spot_noise", f"WITH {_SPOT} SELECT spot, round(max(height / sn), 4) AS noise FROM sp WHERE sn > 0 AND status = 'detected' GROUP BY spot", "features")
def _(spark, sf_dir):
    return U.spot_noise(spot_peaks(spark, sf_dir)).withColumn("noise", F.round("noise", 4))


@query("ag20_counters", f"WITH {_SPOT} SELECT route, status, sample, count(*) AS n FROM sp GROUP BY ALL", "features")
def _(spark, sf_dir):
    return U.counters(spot_peaks(spark, sf_dir), ["route", "status", "sample"])


@query("ag21_group_namespace", "SELECT id, (dense_rank() OVER (ORDER BY sample) - 1) * 1000000 + spot AS global_group FROM features", "features")
def _(spark, sf_dir):
    return A.namespace_groups(features(spark, sf_dir), "spot").select("id", "global_group")


@query("ag22_membership_digests", "SELECT spot, sha256(string_agg(sample || ':' || id, ',' ORDER BY sample || ':' || id)) AS digest, count(*) AS members FROM features GROUP BY spot", "features")
def _(spark, sf_dir):
    return A.membership_digests(features(spark, sf_dir))


@query("tk09_spot_representative", f"WITH {_SPOT} SELECT spot, id FROM sp QUALIFY row_number() OVER (PARTITION BY spot ORDER BY status = 'detected' DESC, sn DESC, height DESC, id) = 1", "features")
def _(spark, sf_dir):
    from peakloom.operators.relations import representatives

    order = [F.desc(F.col("status") == "detected"), F.desc("sn"), F.desc("height"), F.col("id")]
    return representatives(spot_peaks(spark, sf_dir), ["spot"], order).where("chosen").select("spot", "id")


_SAMPLES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("snk01_feature_matrix", "SELECT spot, " + ", ".join(f"coalesce(max(height) FILTER (sample = '{s}'), 0) AS height_{k}" for k, s in enumerate(_SAMPLES)) + " FROM features GROUP BY spot", "features")
def _(spark, sf_dir):
    return A.pivot_samples(features(spark, sf_dir), list(_SAMPLES))


@query("snk09_spot_map", f"WITH {_SPOT} SELECT id, spot, first_value(id) OVER (PARTITION BY spot ORDER BY height DESC, id) AS representative, CASE WHEN row_number() OVER (PARTITION BY spot ORDER BY height DESC, id) = 1 THEN 'representative' ELSE 'member' END AS reason FROM sp", "features")
def _(spark, sf_dir):
    return U.spot_map(spot_peaks(spark, sf_dir))


@query("snk10_notes", "SELECT spot, string_agg(DISTINCT route, '|' ORDER BY route) AS tags, bool_or(route = 'F') AS verified FROM features GROUP BY spot", "features")
def _(spark, sf_dir):
    return U.note_rows(features(spark, sf_dir), "spot", "route", F.col("route") == "F")


@query("cl10_set_operations", f"""WITH {_SPOT}, d AS (SELECT spot, array_agg(DISTINCT sample) FILTER (status = 'detected') AS det, array_agg(DISTINCT sample) FILTER (status = 'filled') AS fil FROM sp GROUP BY spot)
    SELECT spot, coalesce(len(list_filter(fil, lambda x: NOT list_contains(coalesce(det, []), x))), 0) AS only_filled, coalesce(list_has_any(det, fil), false) AS overlap, len(list_distinct(list_concat(coalesce(det, []), coalesce(fil, [])))) AS every FROM d""", "features")  # fmt: skip
def _(spark, sf_dir):
    return U.sample_sets(spot_peaks(spark, sf_dir))


_BOUNDS = "b AS (SELECT *, rt - height % 7 / 10 AS l, rt + height % 5 / 10 AS r FROM features)"


@query("jn20_reused_fills", f"""WITH {_BOUNDS} SELECT DISTINCT x.spot, x.sample FROM b x JOIN b y ON x.route = 'O' AND y.route = 'F' AND x.sample = y.sample AND abs(x.mz - y.mz) <= 5e-2 AND x.spot <> y.spot AND x.rt BETWEEN y.l AND y.r AND y.rt BETWEEN x.l AND x.r""", "features")
def _(spark, sf_dir):
    f = features(spark, sf_dir).withColumns({"apex": F.col("rt"), "left": F.col("rt") - F.col("height") % 7 / 10, "right": F.col("rt") + F.col("height") % 5 / 10})
    return A.reused_fills(f.where("route = 'O'").select("spot", "sample", "mz", "apex", "left", "right"), f.where("route = 'F'"), 0.05)


@query("jn21_segment_routing", """WITH seg AS (SELECT 'S' || k AS segment, k * 30 AS low, k * 30 + 30 AS high FROM (SELECT unnest(generate_series(0, 16)) AS k)), s AS (SELECT id AS spot, mz, CASE WHEN route = 'F' THEN 'S' || (id % 20) ELSE '' END AS segment FROM features)
    SELECT spot, coalesce((SELECT segment FROM seg WHERE seg.segment = s.segment), (SELECT arg_min(segment, low) FROM seg WHERE s.mz BETWEEN low AND high + 1)) AS segment FROM s""", "features")  # fmt: skip
def _(spark, sf_dir):
    segments = spark.range(17).select(F.concat(F.lit("S"), F.col("id")).alias("segment"), (F.col("id") * 30).alias("low"), (F.col("id") * 30 + 30).alias("high"))
    spots = features(spark, sf_dir).select(F.col("id").alias("spot"), "mz", F.when(F.col("route") == "F", F.concat(F.lit("S"), F.col("id") % 20)).otherwise("").alias("segment"))
    return A.routed_segment(spots, segments)


@query("jn22_note_matching", """WITH f AS (SELECT * FROM features), n AS (SELECT c_custkey AS note, c_custkey * 7 AS feature, mz, rt FROM customer JOIN features ON id = c_custkey * 7 + 1 WHERE true),
    e AS (SELECT note FROM n WHERE feature IN (SELECT id FROM f WHERE route <> 'P')), h AS (SELECT note, count(*) AS k, min(f.id) AS hit FROM n JOIN f ON f.route <> 'P' AND abs(n.rt - f.rt) <= 5e-2 AND abs(n.mz - f.mz) <= greatest(n.mz * 5 * 1e-6, 1e-3) WHERE note NOT IN (SELECT note FROM e) GROUP BY note)
    SELECT n.note, CASE WHEN n.note IN (SELECT note FROM e) THEN 'exact' WHEN k = 1 THEN 'auto' WHEN k > 1 THEN 'ambiguous' ELSE 'orphan' END AS state, CASE WHEN n.note IN (SELECT note FROM e) THEN feature WHEN k = 1 THEN hit END AS id FROM n LEFT JOIN h USING (note)""", "features")  # fmt: skip
def _(spark, sf_dir):
    f = features(spark, sf_dir)
    notes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note"), (F.col("c_custkey") * 7).alias("feature")).join(f.select((F.col("id") - 1).alias("feature"), "mz", "rt"), "feature")
    return A.rematch_notes(notes, f.where("route != 'P'"))  # notes on rows that are quantified on the survey scans


@query("ag09_roi_max_eic", """WITH w AS (SELECT run, scan, round(mz * 10000) AS mz, intensity FROM points WHERE intensity > 0), e AS (SELECT run, min(mz) AS start, max(mz) AS stop FROM w GROUP BY run),
    c AS (SELECT run, CAST(unnest(generate_series(0, CAST(ceil((stop - start) / 50000) AS BIGINT) + 1)) AS INT) AS slice, start, stop FROM e)
    SELECT p.run, slice, scan, max(intensity) AS intensity, sum(mz * intensity) / sum(intensity) AS centroid FROM w p JOIN c ON p.run = c.run AND abs(p.mz - (start + slice * 5e4)) <= 5e4 AND start + slice * 5e4 < stop + 2.5e4 GROUP BY ALL""", "points")  # fmt: skip
def _(spark, sf_dir):
    whole = points(spark, sf_dir).withColumn("mz", F.round(F.col("mz") * 10000))  # so that sums are exact
    return X.slice_eics(whole, 50000.0, ["run"], roi=True)


@query("ag12_feature_gaussian", "SELECT spot, coalesce(min(CASE WHEN rt - 5 > 0 THEN rt - 5 END), 0) AS gaussian FROM features GROUP BY spot", "features")
def _(spark, sf_dir):
    return U.least_shape(features(spark, sf_dir), ["spot"], F.col("rt") - 5)


# The quality classes of ions: return flags A high, R middle, N low.
@query("ag17_scan_sharpness", "SELECT scan, max(intensity) AS sharpness FROM points WHERE run IN ('A', 'R') GROUP BY scan", "points")
def _(spark, sf_dir):
    quality = F.when(F.col("run") == "A", "high").when(F.col("run") == "R", "middle").otherwise("low")
    return U.scan_sharpness(points(spark, sf_dir).withColumn("quality", quality), ["scan"], value="intensity")


@query("flt12_admitted", "SELECT id FROM features JOIN (SELECT spec_id FROM spectra GROUP BY spec_id HAVING count(*) + count(*) FILTER (intensity > 45) >= 4 AND count(*) FILTER (intensity > 5) >= 3 AND max(intensity) FILTER (intensity > 5) >= 40) ON id = spec_id", "features spectra")
def _(spark, sf_dir):
    ions = spectra(spark, sf_dir).withColumnRenamed("spec_id", "id")
    enough = U.admitted(features(spark, sf_dir), ions, ions.where("intensity > 45"), ions.where("intensity > 5"), 3, 40.0)
    pairs = U.admitted(enough, ions, ions.where("intensity > 45"), None, 4, 0.0)
    return pairs.select("id")
