"""Queries on centroids and chromatograms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.operators import chromatogram as C
from peakloom.operators import extraction as X
from peakloom.operators import summaries as U
from peakloom.queries.base import chromatograms, points, query, raw_chromatograms, scaled, spectra
from peakloom.session import table


def targets(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select(F.col("p_partkey").alias("target_id"), (F.col("p_retailprice") / 2).alias("target_mz"))


TARGETS = "targets AS (SELECT p_partkey AS target_id, p_retailprice / 2 AS target_mz FROM part)"


@query("ag01_slice_eic", """WITH e AS (SELECT run, min(mz) AS start, max(mz) AS stop FROM points WHERE intensity > 0 GROUP BY run),
    c AS (SELECT run, CAST(unnest(generate_series(0, CAST(ceil((stop - start) / 5) AS BIGINT) + 1)) AS INT) AS slice, start, stop FROM e),
    m AS (SELECT p.run, c.slice, p.scan, p.mz, p.intensity FROM points p JOIN c ON p.run = c.run AND abs(p.mz - (c.start + c.slice * 5e0)) <= 5 AND c.start + c.slice * 5e0 < c.stop + 2.5 AND p.intensity > 0)
    SELECT run, slice, scan, sum(intensity) AS intensity, arg_max(mz, {'i': intensity, 'm': -mz}) AS base_mz FROM m GROUP BY run, slice, scan""", "points")  # fmt: skip
def _(spark, sf_dir):
    return X.slice_eics(points(spark, sf_dir), 5.0, ["run"])


@query("ag02_dense_product_eic", """SELECT channel, scan, intensity FROM chrom""", "chrom")
def _(spark, sf_dir):
    return chromatograms(spark, sf_dir)


for _name, _how in (("ag04_max_eic", "max"), ("ag05_sum_eic", "sum")):

    @query(_name, f"WITH {TARGETS} SELECT target_id, run, scan, {_how}(intensity) AS intensity FROM points JOIN targets ON abs(mz - target_mz) <= 2e-2 GROUP BY ALL", "points")
    def _(spark, sf_dir, how=_how):
        return X.sum_eic(points(spark, sf_dir), targets(spark, sf_dir), 0.02, how)


@query("ag06_window_centroid", f"""WITH {TARGETS} SELECT target_id, run, scan, round(sum(mz * intensity) / sum(intensity), 6) AS centroid
    FROM points JOIN targets ON abs(mz - target_mz) <= 2e-2 GROUP BY ALL""", "points")  # fmt: skip
def _(spark, sf_dir):
    out = X.window_centroid(points(spark, sf_dir), targets(spark, sf_dir), 0.02)
    return out.select("target_id", "run", "scan", scaled("centroid").alias("centroid"))


@query("ag07_base_peak", f"""WITH {TARGETS} SELECT DISTINCT target_id, run, scan, first_value(mz) OVER (PARTITION BY target_id, run, scan ORDER BY intensity DESC, mz) AS base_mz
    FROM points JOIN targets ON abs(mz - target_mz) <= 2e-2""", "points")  # fmt: skip
def _(spark, sf_dir):
    return X.window_centroid(points(spark, sf_dir), targets(spark, sf_dir), 0.02).drop("centroid")


@query("ag08_isotope_ladder", f"""WITH {TARGETS}, f AS (SELECT target_id, run, n, max(intensity) AS height FROM targets CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS n)
    JOIN points ON abs(mz - (target_mz + n * 1.003355e0)) <= 2e-2 GROUP BY ALL)
    SELECT target_id, run, n, height FROM f WHERE (SELECT count(*) FROM f g WHERE g.target_id = f.target_id AND g.run = f.run AND g.n < f.n) = f.n""", "points")  # fmt: skip
def _(spark, sf_dir):
    return X.isotope_ladder(points(spark, sf_dir), targets(spark, sf_dir), 0.02)


@query("ag10_grid_chromatogram", """WITH c AS (SELECT run, scan, mz, intensity, CAST(round_even(mz / 0.5e0, 0) AS BIGINT) AS cell FROM points WHERE intensity > 0)
    SELECT run, cell, scan, max(intensity) AS intensity, first(label_mz) AS label_mz FROM (SELECT *, first_value(mz) OVER (PARTITION BY run, cell ORDER BY scan, mz) AS label_mz FROM c) GROUP BY run, cell, scan""", "points")  # fmt: skip
def _(spark, sf_dir):
    return X.grid_chromatogram(points(spark, sf_dir), 0.5, ["run"])


@query("ag11_acquired_ions", """SELECT run, CAST(round_even(mz / 0.02e0, 0) AS BIGINT) AS cell, arg_min(mz, {'s': scan, 'm': mz}) AS label_mz
    FROM points WHERE scan BETWEEN 997 AND 1003 AND intensity > 0 GROUP BY 1, 2""", "points")  # fmt: skip
def _(spark, sf_dir):
    return X.acquired_ions(points(spark, sf_dir), 1000, 3, 0.02, ["run"])


@query("ag16_cycle_time", """WITH g AS (SELECT channel, scan - lag(scan) OVER (PARTITION BY channel ORDER BY scan) AS gap FROM raw), m AS (SELECT channel, median(gap) AS middle FROM g WHERE gap > 0 GROUP BY channel)
    SELECT median(middle) AS cycle, median(middle) * 2 AS strict FROM m""", "raw")  # fmt: skip
def _(spark, sf_dir):
    gap = F.col("scan") - F.lag("scan").over(C.along())
    middle = raw_chromatograms(spark, sf_dir).withColumn("gap", gap).where("gap > 0").groupBy("channel").agg(F.percentile("gap", F.lit(0.5)).alias("middle"))
    return middle.agg(F.percentile("middle", F.lit(0.5)).alias("cycle")).withColumn("strict", F.col("cycle") * 2)


@query("ag19_noise_factor", """WITH s AS (SELECT channel, scan // 13 AS seg, intensity, avg(intensity) OVER (PARTITION BY channel, scan // 13) AS mean, min(intensity) OVER (PARTITION BY channel, scan // 13) AS low,
      count(*) OVER (PARTITION BY channel, scan // 13) AS n, lag(intensity) OVER (PARTITION BY channel, scan // 13 ORDER BY scan) AS before FROM chrom),
    t AS (SELECT channel, seg, median(abs(intensity - mean)) / sqrt(any_value(mean)) AS nf FROM s GROUP BY channel, seg
      HAVING min(low) > 0 AND any_value(n) = 13 AND sum(CASE WHEN (intensity > mean) <> (before > mean) THEN 1 ELSE 0 END) >= 7)
    SELECT channel, round(median(nf), 6) AS noise_factor FROM t GROUP BY channel""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    return X_noise_factor(chromatograms(spark, sf_dir)).select("channel", scaled("noise_factor").alias("noise_factor"))


def X_noise_factor(series, size: int = 13, crossings: int = 7):
    """Median over segments without zeros and with enough mean crossings of median deviation by root mean."""
    keys = ["channel", "seg"]
    segs = series.withColumn("seg", F.floor(F.col("scan") / size).cast("int"))
    own = Window.partitionBy(*keys)
    segs = segs.withColumns({"mean": F.avg("intensity").over(own), "n": F.count("*").over(own), "low": F.min("intensity").over(own)})
    above = F.col("intensity") > F.col("mean")
    segs = segs.withColumn("above", above).withColumn("crossed", F.lag("above").over(own.orderBy("scan")) != F.col("above"))
    good = segs.where((F.col("n") == size) & (F.col("low") > 0)).groupBy(*keys).agg((F.percentile(F.abs(F.col("intensity") - F.col("mean")), F.lit(0.5)) / F.sqrt(F.first("mean"))).alias("nf"), F.count_if("crossed").alias("k"))
    return good.where(F.col("k") >= crossings).groupBy("channel").agg(F.percentile("nf", F.lit(0.5)).alias("noise_factor"))


@query("src04_centroided", """WITH g AS (SELECT spec_id, mz - lag(mz) OVER (PARTITION BY spec_id ORDER BY mz) AS gap FROM spectra) SELECT spec_id, median(gap) >= 20 AS centroided FROM g GROUP BY spec_id""", "spectra")
def _(spark, sf_dir):
    return X.looks_centroided(spectra(spark, sf_dir), 20.0)


for _name, _gap, _least in (("src05_centroid_profile", 300000.0, 5.0), ("flt10_seed_centroids", 100000.0, 0.0)):

    @query(_name, f"""WITH t AS (SELECT spec_id, round(mz * 10000) AS mz, intensity FROM spectra), g AS (SELECT *, CASE WHEN mz - lag(mz) OVER w > {_gap} THEN 1 ELSE 0 END AS jump FROM t WINDOW w AS (PARTITION BY spec_id ORDER BY mz, intensity)),
        i AS (SELECT *, sum(jump) OVER (PARTITION BY spec_id ORDER BY mz, intensity) AS island FROM g)
        SELECT spec_id, CAST(island AS BIGINT) AS island, sum(mz * intensity) / sum(intensity) AS mz, max(intensity) AS intensity FROM i GROUP BY spec_id, island HAVING max(intensity) >= {_least}""", "spectra")  # fmt: skip
    def _(spark, sf_dir, gap=_gap, least=_least):
        exact = spectra(spark, sf_dir).withColumn("mz", F.round(F.col("mz") * 10000))  # whole numbers, so that sums are exact
        return X.centroid_profile(exact, gap, least)


@query("flt01_has_signal", """SELECT l_partkey AS series, count(*) AS points, max(l_quantity) AS top, median(l_quantity) AS middle FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND max(l_quantity) >= 3 * median(l_quantity)""")
def _(spark, sf_dir):
    series = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("series"), F.col("l_quantity").alias("intensity"))
    return X.has_signal(series, ["series"])


@query("flt02_min_scans", """SELECT run, CAST(floor(mz) AS BIGINT) AS cell, count(DISTINCT scan) AS scans FROM points WHERE intensity > 0 GROUP BY 1, 2 HAVING count(DISTINCT scan) >= 5""", "points")
def _(spark, sf_dir):
    return U.enough_scans(points(spark, sf_dir), ["run", F.floor("mz").alias("cell")], 5)


_W3 = "WINDOW w AS (PARTITION BY channel ORDER BY scan)"


def _weighted(level: int, full: bool, column: str = "intensity") -> str:
    taps = [(level + 1 - abs(k), f"lag({column}, {-k}) OVER w" if k < 0 else f"lead({column}, {k}) OVER w" if k else column) for k in range(-level, level + 1)]
    if full:
        return "(" + " + ".join(f"{w} * coalesce({t}, {column})" for w, t in taps) + f") / {(level + 1) ** 2}"
    return "(" + " + ".join(f"{w} * coalesce({t}, 0)" for w, t in taps) + ") / (" + " + ".join(f"(CASE WHEN {t} IS NULL THEN 0 ELSE {w} END)" for w, t in taps) + ")"


@query("wn01_lwma", f"SELECT channel, scan, round({_weighted(3, False)}, 6) AS smooth FROM chrom {_W3}", "chrom")
def _(spark, sf_dir):
    return chromatograms(spark, sf_dir).select("channel", "scan", scaled(C.lwma("intensity", 3)).alias("smooth"))


@query("wn02_lwma_full", f"SELECT channel, scan, round({_weighted(3, True)}, 6) AS smooth FROM chrom {_W3}", "chrom")
def _(spark, sf_dir):
    return chromatograms(spark, sf_dir).select("channel", "scan", scaled(C.lwma_full("intensity", 3)).alias("smooth"))


_BASE = f"""o AS (SELECT channel, scan, intensity, {_weighted(3, False)} AS once, {_weighted(20, False)} AS base FROM chrom {_W3}),
    s AS (SELECT channel, scan, base, {_weighted(3, False, "once")} AS signal FROM o {_W3}), b AS (SELECT *, greatest(signal - base, 0) AS corrected FROM s)"""


@query("wn03_baseline_noise", f"""WITH {_BASE}, n AS (SELECT channel, scan // 50 AS bin, max(corrected) - min(corrected) AS a FROM b WHERE scan < 700 GROUP BY ALL)
    SELECT channel, round(CASE WHEN count(*) >= 10 THEN median(a) ELSE 1 END * 3, 5) AS noise FROM n GROUP BY channel""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    corrected = C.baseline(chromatograms(spark, sf_dir), 3, 20)
    return C.noise_full_bins(corrected, 720).select("channel", scaled("noise", 5).alias("noise"))


@query("wn04_global_noise", """WITH n AS (SELECT channel, scan // 50 AS bin, max(intensity) - min(intensity) AS a FROM chrom GROUP BY ALL),
    l AS (SELECT channel, list_sort(list(a) FILTER (a > 0)) AS s FROM n GROUP BY channel), m AS (SELECT channel, CASE WHEN len(s) >= 10 THEN s[len(s) // 2 + 1] * 3 ELSE 0 END AS noise FROM l)
    SELECT channel, noise, greatest(1, noise / 3) AS estimated FROM m""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    return C.noise_uneven_bins(chromatograms(spark, sf_dir), "intensity")


def _stencil(weights, column="intensity") -> str:
    taps = [f"lag({column}, 2) OVER w", f"lag({column}) OVER w", column, f"lead({column}) OVER w", f"lead({column}, 2) OVER w"]
    return "coalesce(" + " + ".join(f"({w!r}::DOUBLE) * {t}" for w, t in zip(weights, taps)) + ", 0)"


@query("wn05_derivatives", f"SELECT channel, scan, round({_stencil(C.FIRST)}, 9) AS d1, round({_stencil(C.SECOND)}, 9) AS d2 FROM chrom {_W3}", "chrom")
def _(spark, sf_dir):
    out = C.derivatives(chromatograms(spark, sf_dir), "intensity")
    return out.select("channel", "scan", (F.round("d1", 9) + 0.0).alias("d1"), (F.round("d2", 9) + 0.0).alias("d2"))


@query("wn06_slope_noise", f"""WITH d AS (SELECT channel, abs(intensity - lag(intensity) OVER w) AS back, abs(lead(intensity) OVER w - intensity) AS ahead, abs({_stencil(C.FIRST)}) AS slope, {_stencil(C.SECOND)} AS d2 FROM chrom {_W3}),
    t AS (SELECT *, max(back) OVER (PARTITION BY channel) AS tb, max(slope) OVER (PARTITION BY channel) AS ts, max(CASE WHEN d2 < 0 THEN -d2 END) OVER (PARTITION BY channel) AS tp FROM d),
    l AS (SELECT channel, list_sort(list(ahead) FILTER (ahead > 0 AND ahead < 5e-2 * tb)) AS a, list_sort(list(slope) FILTER (slope > 0 AND slope < 5e-2 * ts)) AS s, list_sort(list(-d2) FILTER (d2 < 0 AND -d2 < 5e-2 * tp)) AS p FROM t GROUP BY channel)
    SELECT channel, round(coalesce(a[len(a) // 2 + 1], 1e-4), 6) AS amplitude_noise, round(coalesce(s[len(s) // 2 + 1], 1e-4), 6) AS slope_noise, round(coalesce(p[len(p) // 2 + 1], 1e-4), 6) AS peaktop_noise FROM l""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    out = C.slope_noises(chromatograms(spark, sf_dir), "intensity")
    return out.select("channel", *[scaled(c).alias(c) for c in ("amplitude_noise", "slope_noise", "peaktop_noise")])


@query("wn08_shape_flags", f"""WITH x AS (SELECT channel, scan, lag(intensity, 2) OVER w AS a, lag(intensity) OVER w AS b, intensity AS c, lead(intensity) OVER w AS d, lead(intensity, 2) OVER w AS e FROM chrom {_W3})
    SELECT channel, scan, coalesce(b <= c AND c >= d, false) AS top, coalesce(a <= b AND b <= c AND c >= d AND d >= e, false) AS large_top, coalesce((a <= b AND b <= c AND c >= d) OR (b <= c AND c >= d AND d >= e), false) AS broad_top,
      coalesce(abs(b - c) < 500 AND abs(c - d) < 500, false) AS flat, coalesce(b >= c AND c <= d, false) AS bottom, coalesce(a >= b AND b >= c AND c <= d AND d <= e, false) AS large_bottom,
      coalesce((a >= b AND b >= c AND c <= d) OR (b >= c AND c <= d AND d <= e), false) AS broad_bottom FROM x""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    return C.shape_flags(chromatograms(spark, sf_dir), flat=500.0).drop("intensity")


@query("wn09_local_peaks", f"""WITH o AS (SELECT channel, scan, round({_weighted(3, True)}, 6) AS v FROM chrom {_W3}),
    n AS (SELECT channel, scan, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM o {_W3}), a AS (SELECT channel, scan AS apex, v AS height FROM n WHERE v > p AND v >= q),
    s AS (SELECT channel, scan FROM n WHERE (v <= p AND v < q) OR p IS NULL OR q IS NULL)
    SELECT a.channel, a.apex, a.height, greatest((SELECT max(scan) FROM s WHERE s.channel = a.channel AND s.scan < a.apex), coalesce((SELECT max(scan) FROM o WHERE o.channel = a.channel AND o.scan < a.apex AND o.v < 5e-2 * a.height), 0)) AS "left",
      least((SELECT min(scan) FROM s WHERE s.channel = a.channel AND s.scan > a.apex), coalesce((SELECT min(scan) FROM o WHERE o.channel = a.channel AND o.scan > a.apex AND o.v < 5e-2 * a.height), 100000)) AS "right" FROM a""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    smooth = chromatograms(spark, sf_dir).select("channel", "scan", scaled(C.lwma_full("intensity", 3)).alias("v"))
    return C.local_peaks(smooth, "v")


@query("wn10_longest_run", """WITH g AS (SELECT channel, scan - row_number() OVER (PARTITION BY channel ORDER BY scan) AS block FROM chrom WHERE intensity > 0), r AS (SELECT channel, count(*) AS n FROM g GROUP BY channel, block)
    SELECT c.channel, any_value(z.zero_share) AS zero_share, max(n) AS longest FROM r c JOIN (SELECT channel, count(*) FILTER (intensity <= 0) / count(*) AS zero_share FROM chrom GROUP BY channel) z USING (channel) GROUP BY c.channel""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    return C.longest_run(chromatograms(spark, sf_dir))


@query("wn11_prominence", """WITH p AS (SELECT channel, scan // 24 AS day, max(intensity) AS top, arg_min(intensity, scan) AS l, arg_max(intensity, scan) AS r FROM chrom GROUP BY ALL)
    SELECT channel, CAST(day AS INT) AS day, top - greatest(l, r) AS least, top - least(l, r) AS most, top - greatest(l, r) >= 500 AND top - least(l, r) >= 2000 AND (top - greatest(l, r)) >= 3e-1 * top AS passes FROM p""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    day = F.floor(F.col("scan") / 24).cast("int").alias("day")
    p = chromatograms(spark, sf_dir).groupBy("channel", day).agg(F.max("intensity").alias("top"), F.min_by("intensity", "scan").alias("l"), F.max_by("intensity", "scan").alias("r"))
    least, most = F.col("top") - F.greatest("l", "r"), F.col("top") - F.least("l", "r")
    return p.select("channel", "day", least.alias("least"), most.alias("most"), ((least >= 500) & (most >= 2000) & (least >= 0.3 * F.col("top"))).alias("passes"))


@query("wn12_gaussian_fit", """WITH p AS (SELECT channel, scan // 24 AS day, scan % 24 AS scan, intensity FROM chrom), m AS (SELECT channel, day, sum(scan * intensity) / sum(intensity) AS mu, sum(intensity) AS mass FROM p GROUP BY ALL),
    s AS (SELECT p.*, mu, sqrt(sum(pow(scan - mu, 2) * intensity) OVER (PARTITION BY channel, day) / mass) AS sd FROM p JOIN m USING (channel, day)), g AS (SELECT *, exp(-0.5 * pow((scan - mu) / sd, 2)) AS model FROM s WHERE sd > 0)
    SELECT channel, CAST(day AS INT) AS day, round(greatest(0, least(1, corr(intensity, model))), 6) AS similarity FROM g GROUP BY channel, day""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    p = chromatograms(spark, sf_dir).select("channel", F.floor(F.col("scan") / 24).cast("int").alias("day"), (F.col("scan") % 24).alias("scan"), "intensity")
    return C.gaussian_fit(p, ["channel", "day"]).withColumn("similarity", scaled("similarity"))


@query("wn17_baseline_correct", """WITH p AS (SELECT channel, CAST(scan // 24 AS INT) AS day, scan, intensity, arg_max(scan, {'i': intensity, 's': -scan}) OVER (PARTITION BY channel, scan // 24) AS apex FROM chrom),
    f AS (SELECT *, arg_min(scan, {'i': intensity, 's': scan}) FILTER (scan <= apex) OVER k AS ls, arg_min(scan, {'i': intensity, 's': scan}) FILTER (scan >= apex) OVER k AS rs, min(intensity) FILTER (scan <= apex) OVER k AS li, min(intensity) FILTER (scan >= apex) OVER k AS ri
      FROM p WINDOW k AS (PARTITION BY channel, day))
    SELECT channel, scan, greatest(0, intensity - trunc(CASE WHEN rs = ls THEN li ELSE li + (ri - li) / (rs - ls) * (scan - ls) END)) AS corrected FROM f""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    own = Window.partitionBy("channel", "day")
    p = chromatograms(spark, sf_dir).withColumn("day", F.floor(F.col("scan") / 24).cast("int"))
    p = p.withColumn("apex", F.max(F.struct("intensity", (-F.col("scan")).alias("s"))).over(own)["s"] * -1)
    low = lambda side: F.min(F.when(side, F.struct("intensity", "scan"))).over(own)
    p = p.withColumns({"l": low(F.col("scan") <= F.col("apex")), "r": low(F.col("scan") >= F.col("apex"))})
    slope = (F.col("r.intensity") - F.col("l.intensity")) / F.nullif(F.col("r.scan") - F.col("l.scan"), F.lit(0))
    line = F.col("l.intensity") + F.coalesce(slope * (F.col("scan") - F.col("l.scan")), F.lit(0.0))
    return p.select("channel", "scan", F.greatest(F.lit(0.0), F.col("intensity") - line.cast("long").cast("double")).alias("corrected"))


@query("wn21_deskew", f"""WITH x AS (SELECT channel, scan, lag(intensity) OVER w AS a, intensity AS b, lead(intensity) OVER w AS c FROM chrom {_W3})
    SELECT channel, scan, round(CASE WHEN a IS NULL OR c IS NULL THEN b ELSE greatest(0, b + (c - a) / 2 * 25e-2 + (a - 2 * b + c) / 2 * 25e-2 * 25e-2) END, 6) AS deskewed FROM x""", "chrom")  # fmt: skip
def _(spark, sf_dir):
    return C.deskew(chromatograms(spark, sf_dir), 0.25).select("channel", "scan", scaled("deskewed").alias("deskewed"))


_PAIRS = "p AS (SELECT x.channel AS a, y.channel AS b, count(*) AS n, corr(x.intensity, y.intensity) AS r FROM chrom x JOIN chrom y ON x.scan = y.scan AND x.channel < y.channel AND x.intensity > 0 AND y.intensity > 0 GROUP BY ALL)"


@query("wn22_pearson", f"WITH {_PAIRS} SELECT a, b, n, round(CASE WHEN n >= 3 THEN coalesce(r, 0) ELSE 0 END, 6) AS pearson FROM p", "chrom")
def _(spark, sf_dir):
    return C.pearson_pairs(chromatograms(spark, sf_dir), ["channel"]).withColumn("pearson", scaled("pearson"))


@query("wn23_coelution", f"WITH {_PAIRS} SELECT a, b, n >= greatest(3, CAST(ceil(n * 5e-1) AS BIGINT)) AND round(r, 6) >= 5e-2 AS coelutes FROM p", "chrom")
def _(spark, sf_dir):
    pairs = C.pearson_pairs(chromatograms(spark, sf_dir), ["channel"])
    floor = F.greatest(F.lit(3), F.ceil(F.col("n") * 0.5))
    return pairs.select("a", "b", C.coelutes(F.col("n"), scaled("pearson"), floor, 0.05).alias("coelutes"))


@query("wn24_median_pearson", f"WITH {_PAIRS} SELECT round(median(r), 6) AS middle, count(*) AS pairs FROM p WHERE n >= 3", "chrom")
def _(spark, sf_dir):
    pairs = C.pearson_pairs(chromatograms(spark, sf_dir), ["channel"]).where("n >= 3")
    return pairs.agg(scaled(F.percentile("pearson", F.lit(0.5))).alias("middle"), F.count("*").alias("pairs"))
