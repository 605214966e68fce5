"""Queries on separation, sources, sinks and whole stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom import stages
from peakloom.operators import alignment as A
from peakloom.operators import relations as R
from peakloom.operators import separation as Z
from peakloom.operators import spectra as S
from peakloom.operators import summaries as U
from peakloom.queries.base import chromatograms, features, points, query, spectra
from peakloom.queries.spectral import ALL_SCORES
from peakloom.queries.spectral import reference
from peakloom.session import materialize, scratch, table
from peakloom.sources import libraries, mzml


def windows(spark, sf_dir):
    """The channels as ions, a week as a window."""
    ions = F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("channel")).cast("double")
    return chromatograms(spark, sf_dir).select(ions.alias("ion"), F.floor(F.col("scan") / 168).alias("week"), (F.col("scan") % 168).alias("scan"), "intensity")


@query("sc17_separated_spectra")
def _(spark, sf_dir):
    return Z.separate_windows(windows(spark, sf_dir), ["week"], amplitude=10.0, apex_tolerance=50)


@query("sc19_extracted_compounds")
def _(spark, sf_dir):
    return Z.extract_compounds(windows(spark, sf_dir), ["week"], 1.0)


@query("cl07_components")
def _(spark, sf_dir):
    return Z.perceive(windows(spark, sf_dir), ["week"], 1.0)


@query("flt11_coelution")
def _(spark, sf_dir):
    return Z.coelution_verdicts(windows(spark, sf_dir), ["week"])


def regions(spark, sf_dir):
    half = F.col("height") % 7 / 20
    return features(spark, sf_dir).select("sample", "id", "mz", (F.col("rt") - half).alias("left"), (F.col("rt") + half).alias("right"), F.col("rt").alias("apex"), "height", F.floor(F.col("mz") * 10).alias("slice"))


@query("tk05_merged_regions")
def _(spark, sf_dir):
    return Z.merge_regions(regions(spark, sf_dir), ["sample"], 0.2)


@query("tk03_slice_twins")
def _(spark, sf_dir):
    return Z.drop_slice_twins(regions(spark, sf_dir), ["sample"], 0.2, 1.0)


_PATHS = "paths AS (SELECT '/data/' || c_mktsegment || '_' || (c_custkey % 9) * 100 || '-' || (c_custkey % 9) * 100 + 29 || CASE c_custkey % 3 WHEN 0 THEN '_1_30_' || c_custkey % 4 WHEN 1 THEN '_' || c_custkey % 4 ELSE '' END || '.mzML' AS path FROM customer)"


def paths(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, F.concat(F.lit("_1_30_"), k % 4)).when(k % 3 == 1, F.concat(F.lit("_"), k % 4)).otherwise("")
    return c.select(F.concat(F.lit("/data/"), "c_mktsegment", F.lit("_"), k % 9 * 100, F.lit("-"), k % 9 * 100 + 29, tail, F.lit(".mzML")).alias("path"))


@query("src07_file_names", f"""WITH {_PATHS}, n AS (SELECT path, regexp_extract(path, '/([^/]*)[.]mzML$', 1) AS stem FROM paths)
    SELECT path, split_part(stem, '_', 1) AS sample, CAST(regexp_extract(stem, '_(\\d+)-', 1) AS INT) AS seg_low, CAST(regexp_extract(stem, '-(\\d+)', 1) AS INT) AS seg_high,
    CASE WHEN stem LIKE '%\\_1\\_30\\_%' ESCAPE '\\' THEN 30 ELSE 0 END AS step, CAST(coalesce(nullif(regexp_extract(stem, '-\\d+_(?:\\d+_30_)?(\\d+)$', 1), ''), '1') AS INT) AS rep FROM n""")  # fmt: skip
def _(spark, sf_dir):
    return paths(spark, sf_dir).select("path", mzml.file_parts(F.col("path")).alias("p")).select("path", "p.*")


@query("src08_file_groups", f"WITH {_PATHS} SELECT path, coalesce(nullif(regexp_extract(path, '-\\d+_(?:\\d+_30_)?(\\d+)[.]mzML$', 1), ''), '1') AS sample FROM paths")
def _(spark, sf_dir):
    return mzml.group_files(paths(spark, sf_dir))


@query("src14_survey_view", "SELECT run, a.scan, coalesce(len(list(mz) FILTER (mz IS NOT NULL)), 0) AS n, coalesce(max(intensity), 0) AS top FROM (SELECT DISTINCT run FROM points) r CROSS JOIN (SELECT unnest(generate_series(0, 2600)) AS scan) a LEFT JOIN points p USING (run, scan) GROUP BY ALL", "points")
def _(spark, sf_dir):
    p = points(spark, sf_dir)
    axis = p.select("run").distinct().select("run", F.explode(F.sequence(F.lit(0), F.lit(2600))).alias("scan"))
    arrays = p.groupBy("run", "scan").agg(F.collect_list("mz").alias("mz"), F.max("intensity").alias("top"))
    return axis.join(arrays, ["run", "scan"], "left").select("run", F.col("scan").cast("long").alias("scan"), F.coalesce(F.size("mz"), F.lit(0)).cast("long").alias("n"), F.coalesce("top", F.lit(0.0)).alias("top"))


@query("src10_msp_round_trip", "SELECT printf('F%05d', spec_id) AS name, count(*) AS peaks, sum(intensity) AS total FROM spectra GROUP BY spec_id", "spectra")
def _(spark, sf_dir):
    path = scratch(spark, "msp")
    arrays = S.to_arrays(spectra(spark, sf_dir), ["spec_id"])
    arrays.select(S.msp_record(F.format_string("F%05d", "spec_id"), F.lit(100.0), F.lit(1.0), F.col("peaks")).alias("value")).write.text(path)
    return libraries.read_msp(spark, path).select("name", F.size("peaks").cast("long").alias("peaks"), F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p["intensity"]).alias("total"))


@query("src11_mgf_round_trip", "SELECT printf('F%05d', spec_id) AS name, count(*) AS peaks, sum(intensity) AS total FROM spectra GROUP BY spec_id", "spectra")
def _(spark, sf_dir):
    path = scratch(spark, "mgf")
    arrays = S.to_arrays(spectra(spark, sf_dir), ["spec_id"])
    arrays.select(S.mgf_record(F.format_string("F%05d", "spec_id"), F.lit(100.0), F.lit(1.0), F.col("peaks")).alias("value")).write.text(path)
    return libraries.read_mgf(spark, path).select("name", F.size("peaks").cast("long").alias("peaks"), F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p["intensity"]).alias("total"))


@query("snk11_blocked_audit", "SELECT sample, count(*) AS blocked, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS digest FROM features WHERE route = 'P' GROUP BY sample", "features")
def _(spark, sf_dir):
    return U.blocked_audit(features(spark, sf_dir).where("route = 'P'"), ["sample"])


@query("jn08_boundary_duplicates", ALL_SCORES + " SELECT query_id, ref_id, round(least(cosine, 1), 6) AS score FROM sc WHERE cosine >= 0.6e0 AND query_id < ref_id", "library")
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return stages.boundary_duplicates(spec, spec, 0.02, 0.6).withColumn("score", F.round("score", 6))


@query("jn17_alias_edges", """SELECT a.id AS a, b.id AS b FROM features a JOIN features b ON a.sample = b.sample AND a.route = 'F' AND b.route = 'O' AND abs(a.mz - b.mz) <= 5e-1 AND abs(a.rt - b.rt) <= 1e0
    AND least(a.height, b.height) / greatest(a.height, b.height) >= 0.9e0""", "features")  # fmt: skip
def _(spark, sf_dir):
    f = features(spark, sf_dir)
    return A.alias_edges(f.where("route = 'F'"), f.where("route = 'O'"), 0.5, 1.0, 0.9)


@query("jn19_covered_rows")
def _(spark, sf_dir):
    f = features(spark, sf_dir).join(S.to_arrays(spectra(spark, sf_dir), ["spec_id"]), F.col("id") == F.col("spec_id")).drop("spec_id")
    return A.covered_rows(f.where("route = 'P'"), f.where("route != 'P'"), 0.05, 0.2)


@query("st4_isotope_marks")
def _(spark, sf_dir):
    f = features(spark, sf_dir)
    return stages.mark(f, R.isotope_links(f, 1.0), "isotope", 1.0, 0, [F.col("mz"), F.desc("height"), F.col("id")])


@query("st4_marks_conserve", "SELECT sample, count(*) AS n FROM features GROUP BY sample", "features")
def _(spark, sf_dir):
    marked = stages.mark(features(spark, sf_dir), R.isotope_links(features(spark, sf_dir), 1.0), "isotope", 1.0, 0, [F.col("mz"), F.desc("height"), F.col("id")])
    return marked.groupBy("sample").agg(F.count("*").alias("n"))


@query("st7_spots")
def _(spark, sf_dir):
    spots, _ = stages.build_spots(features(spark, sf_dir).drop("spot"), 0.02, 0.5)
    return spots


@query("st8_feature_table")
def _(spark, sf_dir):
    from peakloom.sinks.export import feature_matrix

    f = features(spark, sf_dir)
    heads = A.spot_centres(f).select(F.format_string("F%05d", "spot").alias("feature_id"), "mz", "rt")
    cells = f.groupBy("spot", "sample").agg(F.max("height").alias("height"), F.sum("height").alias("area"), F.lit("detected").alias("status"))
    return feature_matrix(heads, materialize(cells.select(F.format_string("F%05d", "spot").alias("feature_id"), "sample", "height", "area", "status"), "cells"))


@query("src17_projects", "SELECT c_custkey AS note, c_mktsegment AS tag, c_acctbal > 0 AS verified FROM customer")
def _(spark, sf_dir):
    from peakloom.sources import projects

    folder = scratch(spark, "project")
    notes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note"), F.col("c_mktsegment").alias("tag"), (F.col("c_acctbal") > 0).alias("verified"))
    projects.save_project({"notes": notes, "spots": notes.select("note")}, folder)
    return projects.load_notes(spark, folder).join(projects.load_project(spark, folder)["spots"], "note", "left_semi")


@query("ag03_running_mean_eics")
def _(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("channel", F.floor(F.col("mz") / 50) * 50)
    return Z.running_mean_eics(p, ["run", "channel"], "channel", 0.02, 10.0, 3)


@query("tk07_recalled_ions")
def _(spark, sf_dir):
    series = windows(spark, sf_dir).withColumns({"rt": F.col("scan") / 60, "channel": F.lit(400)})
    found = spark.createDataFrame([(1, 0.5, [1.0]), (2, 1.5, [2.0, 3.0])], "id long, rt double, mzs array<double>")  # two clusters a week
    clusters = series.select("week", "channel").distinct().join(F.broadcast(found))
    return Z.recall_ions(series, clusters, ["week", "channel"], "channel", run=2).select("week", "id", "mz", "height")


def product_points(spark, sf_dir):
    """Each channel of the events as a sample whose bells three fragments share."""
    from peakloom.queries.aligned import bells

    ions = F.array(*[F.struct(F.lit(m).alias("mz"), F.lit(f).alias("f")) for m, f in ((100.05, 1.0), (150.07, 0.7), (210.1, 0.4))])
    rows = bells(spark, sf_dir).withColumn("x", F.explode(ions))
    return rows.select(F.col("channel").alias("sample"), F.lit(400).alias("channel"), "scan", (F.col("scan") / 60).alias("rt"), F.col("x.mz").alias("mz"), (F.col("intensity") * F.col("x.f")).alias("intensity"))


@query("st1_product_features")
def _(spark, sf_dir):
    found, _ = stages.detect_from_products(product_points(spark, sf_dir), amplitude=50.0, least_base=100.0, tolerance=0.05, span=0.1)
    return found


@query("st2_survey_masses")
def _(spark, sf_dir):
    f = features(spark, sf_dir).withColumns({"channel": F.round("mz").cast("long"), "left": F.col("rt") - F.col("height") % 7 / 50, "right": F.col("rt") + F.col("height") % 5 / 50})
    survey = f.select("sample", F.floor(F.col("rt") * 20).alias("scan"), (F.floor(F.col("rt") * 20) / 20).alias("rt"), "mz", F.col("height").alias("intensity"))
    told = stages.assign_survey(f.where("route = 'O'").select("sample", "channel", "id", "rt", "left", "right"), f.where("route = 'F' AND id % 2 = 0"), f.where("route = 'F' AND id % 2 = 1"), survey, 0.1)
    return told.select("sample", "channel", "id", "survey_mz", "mz_source", "mz_confidence", "signal_type")


@query("st25_inferred_masses")
def _(spark, sf_dir):
    ions = spectra(spark, sf_dir).withColumnRenamed("spec_id", "id")
    f = ions.groupBy("id").agg((F.floor(F.max("mz")) + 18).alias("channel"), F.count("*").alias("n_fragments"))
    empty = F.lit("")
    lacking = f.withColumns({"signal_type": F.lit("ms2_only"), "mz_source": empty, "mz_confidence": empty})
    hits = f.where("id % 10 = 0").select("id", (F.col("channel") + 0.25).alias("precursor"))
    return stages.infer_masses(lacking, ions, hits).select("id", "channel", "inferred_mz", "mz_source", "mz_confidence")


@query("st7_gap_fills")
def _(spark, sf_dir):
    from peakloom.queries.aligned import bells

    traces = bells(spark, sf_dir).select(F.lit(1).alias("spot"), F.col("channel").alias("sample"), "scan", "intensity")
    members = traces.where("sample IN ('click', 'view') AND scan = 120").select("spot", "sample", (F.col("scan") / 60).alias("rt"))  # the spot is seated in two samples
    return stages.fill_spots(members, traces, traces)
