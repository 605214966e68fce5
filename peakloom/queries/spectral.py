"""Queries on spectra: projections, clean-up, rendering, library search and scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.operators import library as L
from peakloom.operators import spectra as S
from peakloom.plans.bands import spread_out
from peakloom.queries.base import library, query, spectra
from peakloom.session import table


def precursors(spark, sf_dir):
    """Spectra with a precursor from their order."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_id"), (F.col("o_totalprice") / 1000).alias("precursor"))
    return spread_out(spectra(spark, sf_dir), ["spec_id"]).join(t, "spec_id")


_PRE = "pre AS (SELECT s.spec_id, mz, intensity, o_totalprice / 1000 AS precursor FROM spectra s JOIN orders ON o_orderkey = s.spec_id)"


@query("flt04_flat_noise", "SELECT spec_id, mz, intensity FROM spectra QUALIFY count(*) OVER (PARTITION BY spec_id, intensity) < 2", "spectra")
def _(spark, sf_dir):
    return S.drop_flat_noise(spectra(spark, sf_dir), ["spec_id"], 2)


@query("flt05_intensity_floor", "SELECT spec_id, mz, intensity FROM spectra QUALIFY intensity >= greatest(5, 0.2e0 * max(intensity) OVER (PARTITION BY spec_id))", "spectra")
def _(spark, sf_dir):
    return S.intensity_floor(spectra(spark, sf_dir), ["spec_id"], 5.0, 0.2)


@query("flt06_before_precursor", f"WITH {_PRE} SELECT spec_id, mz, intensity FROM pre WHERE mz <= precursor + 1.5e0", "spectra")
def _(spark, sf_dir):
    return S.before_precursor(precursors(spark, sf_dir), "precursor").select("spec_id", "mz", "intensity")


@query("flt07_top_n", "SELECT spec_id, mz, intensity FROM spectra QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, mz) <= 3", "spectra")
def _(spark, sf_dir):
    return S.keep_top(spectra(spark, sf_dir), ["spec_id"], 3)


@query("flt08_cleanup", f"""WITH {_PRE}, f AS (SELECT * FROM pre QUALIFY count(*) OVER (PARTITION BY spec_id, intensity) < 3), t AS (SELECT * FROM f QUALIFY intensity >= 0.1e0 * max(intensity) OVER (PARTITION BY spec_id)),
    c AS (SELECT * FROM t WHERE mz <= precursor + 1.5e0) SELECT spec_id, mz, intensity FROM c QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, mz) <= 4""", "spectra")  # fmt: skip
def _(spark, sf_dir):
    steps = S.intensity_floor(S.drop_flat_noise(precursors(spark, sf_dir), ["spec_id"], 3), ["spec_id"], 0.0, 0.1)
    return S.keep_top(S.before_precursor(steps, "precursor"), ["spec_id"], 4).select("spec_id", "mz", "intensity")


@query("flt03_merge_close_cleanup")
def _(spark, sf_dir):
    return S.clean_spectra(precursors(spark, sf_dir), ["spec_id"], "precursor", base=3.0, flat=3, share=0.05, most=50)


@query("flt09_msdec_seeds", f"WITH {_PRE} SELECT spec_id, mz, intensity FROM pre QUALIFY intensity > greatest(0.05e0 * max(intensity) OVER (PARTITION BY spec_id), 3e0, 0.1e0) AND mz <= floor(precursor) + 5", "spectra")
def _(spark, sf_dir):
    top = F.max("intensity").over(Window.partitionBy("spec_id"))
    seeds = precursors(spark, sf_dir).withColumn("top", top)
    return seeds.where((F.col("intensity") > F.greatest(F.col("top") * 0.05, F.lit(3.0), F.lit(0.1))) & (F.col("mz") <= F.floor("precursor") + 5)).select("spec_id", "mz", "intensity")


@query("flt17_representative_mz", """WITH t AS (SELECT *, max(intensity) OVER (PARTITION BY spec_id) AS top, intensity = 25 AS bad FROM spectra)
    SELECT spec_id, coalesce(max(mz) FILTER (intensity >= top * 0.05e0 AND NOT bad), max(mz) FILTER (NOT bad), max(mz) FILTER (intensity >= top * 0.05e0), max(mz)) AS rep_mz FROM t GROUP BY spec_id""", "spectra")  # fmt: skip
def _(spark, sf_dir):
    return S.representative_mz(spectra(spark, sf_dir), ["spec_id"], F.col("intensity") == 25)


@query("flt18_peak_list", """WITH t AS (SELECT * FROM spectra QUALIFY intensity >= 5 AND row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, mz) <= 5)
    SELECT spec_id, string_agg(printf('%.4f:%.0f:%s', mz, intensity, CASE WHEN intensity >= 25 THEN 'strong' ELSE 'weak' END), ' ' ORDER BY mz, intensity) AS peaks FROM t GROUP BY spec_id""", "spectra")  # fmt: skip
def _(spark, sf_dir):
    some = S.to_arrays(S.keep_top(spectra(spark, sf_dir), ["spec_id"], 5).where("intensity >= 5"), ["spec_id"])
    text = F.array_join(F.transform("peaks", lambda p: F.concat(F.format_string("%.4f:%.0f:", p["mz"], p["intensity"]), F.when(p["intensity"] >= 25, "strong").otherwise("weak"))), " ")
    return some.select("spec_id", text.alias("peaks"))


@query("tk08_representative_ion", "SELECT spec_id, arg_max(mz, {'i': intensity, 'm': mz}) AS rep_mz FROM spectra GROUP BY spec_id", "spectra")
def _(spark, sf_dir):
    return S.representative_ion(spectra(spark, sf_dir), ["spec_id"])


@query("tk13_top_fragments", "SELECT spec_id, mz, intensity, row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, mz) AS place FROM spectra QUALIFY place <= 2", "spectra")
def _(spark, sf_dir):
    from peakloom.plans.bands import top_k

    return top_k(spectra(spark, sf_dir), ["spec_id"], [F.desc("intensity"), F.col("mz")], 2, "place").withColumn("place", F.col("place").cast("long"))


@query("prj03_spectrum_string", "SELECT spec_id, string_agg(printf('%.5f:%.0f', mz, intensity), ' ' ORDER BY mz, intensity) AS spectrum FROM spectra GROUP BY spec_id", "spectra")
def _(spark, sf_dir):
    return S.to_arrays(spectra(spark, sf_dir), ["spec_id"]).select("spec_id", S.joined(F.col("peaks"), "%.5f:%.0f", " ").alias("spectrum"))


_RECORD = f"WITH {_PRE}, g AS (SELECT spec_id, precursor, list(mz ORDER BY mz, intensity) AS m, list(intensity ORDER BY mz, intensity) AS i FROM pre GROUP BY ALL) SELECT spec_id, "


def records(spark, sf_dir, render):
    arrays = S.to_arrays(precursors(spark, sf_dir), ["spec_id", "precursor"])
    rt = F.col("precursor") / 100
    return arrays.select("spec_id", render(F.format_string("F%05d", F.col("spec_id")), F.col("precursor"), rt, F.col("peaks")).alias("record"))


@query("snk02_mgf", _RECORD + r"""'BEGIN IONS' || chr(10) || printf('TITLE=F%05d', spec_id) || chr(10) || printf('PEPMASS=%.5f', precursor) || chr(10) || printf('RTINSECONDS=%.1f', precursor / 100 * 60) || chr(10)
    || array_to_string(list_transform(range(1, len(m) + 1), lambda k: printf('%.5f %.1f', m[k], i[k])), chr(10)) || chr(10) || 'END IONS' || chr(10) AS record FROM g""", "spectra")
def _(spark, sf_dir):
    return records(spark, sf_dir, S.mgf_record)


@query("snk03_msp", _RECORD + r"""'NAME: ' || printf('F%05d', spec_id) || chr(10) || printf('PRECURSORMZ: %.5f', precursor) || chr(10) || printf('RETENTIONTIME: %.7f', precursor / 100) || chr(10) || printf('Num Peaks: %d', len(m)) || chr(10)
    || array_to_string(list_transform(range(1, len(m) + 1), lambda k: printf('%.5f', m[k]) || chr(9) || printf('%.0f', i[k])), chr(10)) || chr(10) AS record FROM g""", "spectra")
def _(spark, sf_dir):
    return records(spark, sf_dir, S.msp_record)


# Library search. Spectra of the grid get precursors that put about a tenth of a bucket within the tolerance.
_LIB = """lib AS (SELECT spec_id, bucket, mz, intensity, 100 + bucket + (spec_id % 100) / 100 AS precursor FROM library WHERE intensity > 0)"""
_SPEC = "spec AS (SELECT DISTINCT spec_id, precursor FROM lib)"
_CAND = "cand AS (SELECT a.spec_id AS query_id, b.spec_id AS ref_id, a.precursor AS query_mz, b.precursor AS ref_mz FROM spec a JOIN spec b ON abs(a.precursor - b.precursor) <= 2e-2 AND a.spec_id <> b.spec_id)"
_MATCH = """m AS (SELECT query_id, ref_id, count(*) AS n, sum(x.intensity * y.intensity) AS total, sum(sqrt(x.intensity / xt * (y.intensity / yt)) * x.mz) AS cw, sum(sqrt(x.intensity / xt * (y.intensity / yt))) AS cs,
      sum(x.intensity / xt * x.mz) AS mq, sum(y.intensity / yt * y.mz) AS mr, count(*) FILTER (y.intensity >= yt * 1e-2) AS sig
    FROM cand JOIN lib x ON x.spec_id = query_id JOIN lib y ON y.spec_id = ref_id AND y.mz = x.mz JOIN (SELECT spec_id AS xi, max(intensity) AS xt FROM lib GROUP BY 1) ON xi = query_id JOIN (SELECT spec_id AS yi, max(intensity) AS yt FROM lib GROUP BY 1) ON yi = ref_id GROUP BY ALL),
    st AS (SELECT spec_id, count(*) AS peaks, sum(intensity * intensity) AS sq, sum(intensity / top) AS rel, sum(intensity / top * mz) AS mass, count(*) FILTER (intensity >= top * 1e-2) AS strong FROM (SELECT *, max(intensity) OVER (PARTITION BY spec_id) AS top FROM lib) GROUP BY spec_id),
    sc AS (SELECT m.query_id, m.ref_id, n, total / sqrt(q.sq * r.sq) AS cosine, cw * cw / (q.mass * r.mass) AS wdp, cs * cs / (q.rel * r.rel) AS sdp, cw * cw / (mq * r.mass) AS rdp, sig / r.strong AS pct, q.peaks AS qn, r.peaks AS rn, total FROM m JOIN st q ON q.spec_id = query_id JOIN st r ON r.spec_id = ref_id)"""
ALL_SCORES = _ALL = f"WITH {_LIB}, {_SPEC}, {_CAND}, {_MATCH}"


def reference(spark, sf_dir):
    """The library as one row per spectrum: spec_id, precursor, peaks."""
    rows = library(spark, sf_dir).where("intensity > 0").withColumn("precursor", 100 + F.col("bucket") + (F.col("spec_id") % 100) / 100)
    return S.to_arrays(rows, ["spec_id", "precursor"])


def candidates(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.candidates(spec, spec, 0.02).where("query_id != ref_id")


@query("jn02_library_candidates", f"WITH {_LIB}, {_SPEC}, {_CAND} SELECT query_id, ref_id FROM cand", "library")
def _(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "ref_id")


@query("jn01_greedy_match", _ALL + " SELECT query_id, ref_id, n AS n_matched, total FROM m", "library")
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.products(spec, spec, 0.02, 0.02)


@query("sc02_cosine", _ALL + " SELECT query_id, ref_id, n AS n_matched, round(least(cosine, 1), 6) AS score FROM sc", "library")
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.cosines(spec, spec, 0.02, 0.02).withColumn("score", F.round("score", 6))


# Precursors 0.015 apart at most, so that rounding moves no pair of grid points across the tolerance of 0.02.
_NEAR = _CAND.replace("2e-2", "1.5e-2")


@query("sc03_modified_cosine", f"""WITH {_LIB}, {_SPEC}, {_NEAR}, far AS (SELECT * FROM lib WHERE abs(mz - precursor) > 1.5e0), w AS (SELECT spec_id, sum(intensity * intensity) AS sq FROM far GROUP BY 1),
    p AS (SELECT query_id, ref_id, count(*) AS n, sum(x.intensity * y.intensity) AS total FROM cand JOIN far x ON x.spec_id = query_id JOIN far y ON y.spec_id = ref_id AND y.mz = x.mz GROUP BY ALL)
    SELECT query_id, ref_id, n AS n_matched, round(least(total / sqrt(q.sq * r.sq), 1), 6) AS score FROM p JOIN w q ON q.spec_id = query_id JOIN w r ON r.spec_id = ref_id""", "library")  # fmt: skip
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.modified_cosines(spec, spec, 0.015, 0.02).withColumn("score", F.round("score", 6))


@query("sc04_neutral_loss_cosine", f"WITH {_LIB}, {_SPEC}, {_NEAR}, {_MATCH} SELECT query_id, ref_id, n AS n_matched, round(least(cosine, 1), 6) AS score FROM sc", "library")
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.loss_cosines(spec, spec, 0.015, 0.02, 600).withColumn("score", F.round("score", 6))


def composites(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.composite_scores(spec, spec, 0.02, 0.02)


@query("sc05_dot_products", _ALL + " SELECT query_id, ref_id, round(least(wdp, 1), 6) AS wdp, round(least(sdp, 1), 6) AS sdp, round(least(rdp, 1), 6) AS rdp FROM sc", "library")
def _(spark, sf_dir):
    return composites(spark, sf_dir).select("query_id", "ref_id", *[F.round(c, 6).alias(c) for c in ("wdp", "sdp", "rdp")])


_TOTAL = "round((sqrt(least(wdp, 1)) + sqrt(least(sdp, 1)) + sqrt(least(rdp, 1))) / 3 + pct, 6)"


@query("sc06_composite", _ALL + f" SELECT query_id, ref_id, {_TOTAL} AS score, round(pct, 6) AS matched_pct, n AS n_matched FROM sc", "library")
def _(spark, sf_dir):
    return composites(spark, sf_dir).select("query_id", "ref_id", F.round("score", 6).alias("score"), F.round("matched_pct", 6).alias("matched_pct"), "n_matched")


@query("tk01_top_hits", _ALL + f", h AS (SELECT query_id, ref_id, {_TOTAL} AS score, n FROM sc) SELECT query_id, ref_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS place FROM h WHERE n >= 3 QUALIFY place <= 5", "library")
def _(spark, sf_dir):
    return L.top_hits(composites(spark, sf_dir).withColumn("score", F.round("score", 6)), 5, 3).select("query_id", "ref_id", "score", F.col("place").cast("long").alias("place"))


@query("jn03_inference", _ALL + f""", h AS (SELECT query_id, ref_id, {_TOTAL} AS score, n FROM sc), b AS (SELECT * FROM h WHERE n >= 3 AND score >= 1.6e0)
    SELECT query_id, arg_max(ref_id, {{'s': score, 'r': -ref_id}}) AS ref_id, max(score) AS score FROM b GROUP BY query_id""", "library")  # fmt: skip
def _(spark, sf_dir):
    good = composites(spark, sf_dir).withColumn("score", F.round("score", 6)).where("n_matched >= 3 AND score >= 1.6")
    return good.groupBy("query_id").agg(F.max_by("ref_id", F.struct("score", -F.col("ref_id"))).alias("ref_id"), F.max("score").alias("score"))


@query("flt13_high_confidence", _ALL + f" SELECT query_id, ref_id, {_TOTAL} >= 1.5e0 AND n >= 60 AS confident FROM sc", "library")
def _(spark, sf_dir):
    return composites(spark, sf_dir).select("query_id", "ref_id", L.high_confidence(F.round("score", 6), F.col("n_matched"), 1.5, 60).alias("confident"))


@query("sc09_identity", _ALL + " SELECT query_id, ref_id, CASE WHEN least(qn, rn) < 3 THEN 'UNJUDGEABLE' WHEN round(cosine, 6) >= 0.7e0 AND n >= 3 THEN 'SAME' ELSE 'DIFFERENT' END AS state FROM sc", "library")
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.identities(spec, spec, 0.02, 0.02, 0.7)


@query("sc11_upper_bound", _ALL + " SELECT query_id, ref_id, round(pct, 6) AS bound FROM sc", "library")
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.matched_bound(spec, spec, 0.02, 0.02).select("query_id", "ref_id", F.round("bound", 6).alias("bound"))


@query("sc12_library_index", f"""WITH {_LIB}, {_SPEC}, c AS (SELECT spec_id, CAST(round_even(precursor, 0) AS INT) AS cell, count(*) AS peaks FROM lib GROUP BY ALL)
    SELECT spec_id, cell, peaks, CAST(sum(peaks) OVER (PARTITION BY cell ORDER BY spec_id) AS BIGINT) - peaks AS start FROM c""", "library")  # fmt: skip
def _(spark, sf_dir):
    return L.bucket_index(reference(spark, sf_dir))


@query("sc13_rerank", _ALL + f", h AS (SELECT query_id, ref_id, 0.8e0 * {_TOTAL} + 0.2e0 * exp(-0.5e0 * pow((query_id - ref_id) / 100e0, 2)) AS s FROM sc) SELECT query_id, ref_id, round(s, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 5) DESC, ref_id) AS place FROM h", "library")
def _(spark, sf_dir):
    hits = composites(spark, sf_dir).withColumn("score", F.round("score", 6))
    term = L.gaussian(F.col("query_id"), F.col("ref_id"), 100.0)
    return L.rerank(hits, F.lit(0.8) * F.col("score") + F.lit(0.2) * term).select("query_id", "ref_id", F.col("reranked").alias("score"), F.col("place").cast("long").alias("place"))


@query("jn23_acquired_intersection", f"""WITH {_LIB} SELECT a.spec_id, a.mz FROM lib a WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT l_extendedprice / 100 AS q FROM lineitem WHERE l_quantity = 50) t WHERE abs(q - a.mz) <= 5e-2)""", "library")
def _(spark, sf_dir):
    ions = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select((F.col("l_extendedprice") / 100).alias("acquired")).distinct()
    return L.acquired_only(library(spark, sf_dir).where("intensity > 0"), ions, 0.05).select("spec_id", "mz")


@query("sc08_ratio_boosted_cosine", f"""WITH {_LIB}, {_SPEC}, {_CAND}, j AS (SELECT query_id, ref_id, mz, x.intensity AS a, y.intensity AS b, sqrt(x.intensity) * mz * mz AS wa, sqrt(y.intensity) * mz * mz AS wb
      FROM cand JOIN lib x ON x.spec_id = query_id JOIN lib y USING (mz) WHERE y.spec_id = ref_id),
    r AS (SELECT *, a / lag(a) OVER w * (lag(b) OVER w / b) AS ratio FROM j WINDOW w AS (PARTITION BY query_id, ref_id ORDER BY mz)),
    s AS (SELECT query_id, ref_id, count(*) AS m, sum(wa * wb) AS ab, sum(least(ratio, 1 / ratio)) / (count(*) - 1) AS fr FROM r GROUP BY ALL), t AS (SELECT spec_id, sum(intensity * pow(mz, 4)) AS sq, count(*) AS n FROM lib GROUP BY 1)
    SELECT query_id, ref_id, round(((q.n + p.n - m) * (ab * ab / (q.sq * p.sq)) + m * fr) / (q.n + p.n - m + m), 6) AS score FROM s JOIN t q ON q.spec_id = query_id JOIN t p ON p.spec_id = ref_id WHERE m >= 3""", "library")  # fmt: skip
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.boosted_cosine(spec, spec, 0.02, 3).select("query_id", "ref_id", F.round("score", 6).alias("score"))


@query("sc10_gcms_match_factor")
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.match_factors(spec, spec, 0.02, 0.02)


@query("flt15_best_variant", _ALL + " SELECT query_id, arg_max(ref_id, {'c': round(cosine, 6), 'r': -ref_id}) AS ref_id FROM sc GROUP BY query_id", "library")
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    out = L.cosines(spec, spec, 0.02, 0.02)
    return out.groupBy("query_id").agg(F.max_by("ref_id", F.struct(F.round("score", 6), -F.col("ref_id"))).alias("ref_id"))


@query("st65_annotation")
def _(spark, sf_dir):
    spec = reference(spark, sf_dir)
    return L.annotate(spec, spec, tolerance=0.02, score_floor=0.7, least_matched=3, most=5)
