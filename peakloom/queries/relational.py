"""Queries on relations between the features of a sample."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.operators import relations as R
from peakloom.plans.graph import near_blocks
from peakloom.queries.base import features, query, spectra
from peakloom.session import table

MZ, RT = 0.2, 1.0
_EDGES = f"e AS (SELECT a.id AS a, b.id AS b FROM features a JOIN features b ON a.sample = b.sample AND a.id < b.id AND abs(a.mz - b.mz) <= {MZ}::DOUBLE AND abs(a.rt - b.rt) <= {RT}::DOUBLE)"


def close_pairs(spark, sf_dir, *needed, **told):
    """Pairs (a, b) and what is told of them, which may look at sample, mz, rt and the columns ``needed``."""
    pairs = R.pair_edges(features(spark, sf_dir).select("id", "sample", "mz", "rt", *needed), MZ, RT, **told)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), *told)


def edges(spark, sf_dir):
    return close_pairs(spark, sf_dir)


@query("jn11_duplicate_edges", f"WITH {_EDGES} SELECT a, b FROM e", "features")
def _(spark, sf_dir):
    return edges(spark, sf_dir)


_COMPONENTS = f"""WITH RECURSIVE {_EDGES}, both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT id AS a, id AS b FROM features UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
    lab AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)"""


def labelled(spark, sf_dir):
    return near_blocks(features(spark, sf_dir), F.col("id"), ["sample"], "mz", "rt", MZ, RT, "root")


def recursive(tail: str) -> str:
    """The statement with the shape's table first and RECURSIVE at its head."""
    from peakloom.queries.base import SHAPES

    return _COMPONENTS.replace("WITH RECURSIVE ", f"WITH RECURSIVE features AS ({SHAPES['features']}), ") + tail


@query("cl03_components", recursive(" SELECT id, root FROM lab"))
def _(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "root")


_PARTS = """, g AS (SELECT f.*, root, CASE WHEN rt - lag(rt) OVER (PARTITION BY root ORDER BY rt, f.id) > 0.5e0 THEN 1 ELSE 0 END AS jump FROM lab JOIN features f ON f.id = lab.id),
    p AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY root ORDER BY rt, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM g)"""


@query("cl04_rt_split", recursive(_PARTS + " SELECT id, root, part FROM p"))
def _(spark, sf_dir):
    return R.split_at_gaps(labelled(spark, sf_dir), 0.5).select("id", "root", "part")


@query("cl05_representatives", recursive(_PARTS + """ SELECT id, row_number() OVER (PARTITION BY root, part ORDER BY mz, height DESC, id) = 1 AS lightest, row_number() OVER (PARTITION BY root, part ORDER BY height DESC, id) = 1 AS tallest FROM p"""))
def _(spark, sf_dir):
    parts = R.split_at_gaps(labelled(spark, sf_dir), 0.5)
    first = R.representatives(parts, ["root", "part"], [F.col("mz"), F.desc("height"), F.col("id")]).withColumnRenamed("chosen", "lightest")
    return R.representatives(first, ["root", "part"], [F.desc("height"), F.col("id")]).select("id", "lightest", F.col("chosen").alias("tallest"))


def steps(most=4):
    return [n * R.ISOTOPES[0][1] for n in range(1, most + 1)] + [d for _, d in R.ISOTOPES[1:]]


_DELTA = "(b.mz - a.mz)"
_STEPS = "[" + ", ".join(f"{s!r}::DOUBLE" for s in steps()) + "]"
_CLASS = f"CASE WHEN list_min(list_transform({_STEPS}, lambda s: abs({_DELTA} - s))) <= 1e-2 THEN 'classic' WHEN list_min(list_transform([1e0, 2e0, 3e0, 4e0], lambda s: abs({_DELTA} - s))) <= 2e-2 THEN 'relaxed' END"


@query("jn09_isotope_edges", f"""WITH p AS (SELECT a.id AS light, b.id AS heavy, {_CLASS} AS gap, {_STEPS}[list_position(list_transform({_STEPS}, lambda s: abs({_DELTA} - s)), list_min(list_transform({_STEPS}, lambda s: abs({_DELTA} - s))))] AS step
      FROM features a JOIN features b ON a.sample = b.sample AND b.mz > a.mz AND {_DELTA} < 4.1e0 AND abs(a.rt - b.rt) <= 1e0
      WHERE NOT abs({_DELTA} - 1.003355e0) <= 2e-2 OR b.height <= a.height * greatest(1e0, a.mz / 12 * 0.011e0 * 2)) SELECT * FROM p WHERE gap IS NOT NULL""", "features")  # fmt: skip
def _(spark, sf_dir):
    return R.isotope_edges(features(spark, sf_dir), 1.0)


_ADD = "ad AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {m!r}::DOUBLE, {c}, {k})" for i, (n, m, c, k) in enumerate(R.POSITIVE)) + ") t(place, adduct, added, charge, mult))"
_MASSES = f"{_ADD}, ms AS (SELECT id, sample, rt, place, adduct, (mz * charge - added) / mult AS mass FROM features CROSS JOIN ad)"


@query("sc15_neutral_masses", f"WITH {_MASSES} SELECT id, adduct, mass FROM ms", "features")
def _(spark, sf_dir):
    return R.neutral_masses(features(spark, sf_dir)).select("id", "adduct", "mass")


@query("jn10_adduct_edges", f"""WITH {_MASSES}, cells AS (SELECT *, unnest([-1, 0, 1]) + CAST(floor(mass / 2e-2) AS BIGINT) AS cell FROM ms),
    p AS (SELECT x.id AS a, y.id AS b, x.adduct AS adduct_a, y.adduct AS adduct_b, x.place AS i, y.place AS j FROM ms x JOIN cells y ON x.sample = y.sample AND CAST(floor(x.mass / 2e-2) AS BIGINT) = y.cell
      AND x.id < y.id AND x.place <> y.place AND abs(x.mass - y.mass) <= 2e-2 AND abs(x.rt - y.rt) <= 1e0)
    SELECT a, b, adduct_a, adduct_b FROM p QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY i, j) = 1""", "features")  # fmt: skip
def _(spark, sf_dir):
    return R.adduct_edges(features(spark, sf_dir), 1.0)


@query("sc16_isotope_steps", f"""SELECT a.id AS a, b.id AS b, {_CLASS} AS gap, {_STEPS}[list_position(list_transform({_STEPS}, lambda s: abs({_DELTA} - s)), list_min(list_transform({_STEPS}, lambda s: abs({_DELTA} - s))))] AS step
    FROM features a JOIN features b ON a.sample = b.sample AND b.mz - a.mz BETWEEN 0.9e0 AND 1.1e0 AND abs(a.rt - b.rt) <= 1e0 AND a.id <> b.id""", "features")  # fmt: skip
def _(spark, sf_dir):
    return R.isotope_pairs(features(spark, sf_dir), 0.9, 1.1, 1.0)


@query("sc15_overlap_ratio", f"""WITH {_EDGES}, w AS (SELECT id, rt - height % 7 / 10 AS l, rt + height % 5 / 10 AS r FROM features)
    SELECT a, b, round(CASE WHEN least(x.r - x.l, y.r - y.l) > 0 THEN least(1e0, greatest(0e0, least(x.r, y.r) - greatest(x.l, y.l)) / least(x.r - x.l, y.r - y.l)) ELSE 0 END, 6) AS ratio FROM e JOIN w x ON x.id = a JOIN w y ON y.id = b""", "features")  # fmt: skip
def _(spark, sf_dir):
    l, r = (lambda s: F.col(f"rt_{s}") - F.col(f"height_{s}") % 7 / 10), (lambda s: F.col(f"rt_{s}") + F.col(f"height_{s}") % 5 / 10)
    return close_pairs(spark, sf_dir, "height", ratio=F.round(R.overlap_ratio(l("a"), r("a"), l("b"), r("b")), 6))


@query("sc01_gaussian", f"WITH {_EDGES} SELECT a, b, round(exp(-0.5e0 * pow((x.rt - y.rt) / 0.3e0, 2)), 6) AS similarity FROM e JOIN features x ON x.id = a JOIN features y ON y.id = b", "features")
def _(spark, sf_dir):
    from peakloom.operators.library import gaussian

    return close_pairs(spark, sf_dir, similarity=F.round(gaussian(F.col("rt_a"), F.col("rt_b"), 0.3), 6))


@query("jn12_fragment_parents", """SELECT c.id AS child, arg_min(p.id, {'m': p.mz, 'i': p.id}) AS parent FROM features c JOIN spectra s ON abs(c.mz - s.mz) <= 2e-2 JOIN features p ON p.id = s.spec_id AND p.sample = c.sample AND p.mz > c.mz AND abs(p.rt - c.rt) <= 2e0 GROUP BY c.id""", "features spectra")
def _(spark, sf_dir):
    return R.fragment_parents(features(spark, sf_dir), spectra(spark, sf_dir), 2.0, 0.02)


@query("sc07_isotope_echo", f"""WITH {_EDGES}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, mz) AS r FROM spectra) WHERE r <= 6)
    SELECT a AS light, b AS heavy, count(*) FILTER (hit) AS matched, count(*) AS considered FROM (SELECT a, b, r, bool_or(abs(t.mz + 1.003355e0 - s.mz) <= 5e0) AS hit FROM e JOIN t ON t.spec_id = a JOIN spectra s ON s.spec_id = b GROUP BY ALL) GROUP BY ALL""", "features spectra")  # fmt: skip
def _(spark, sf_dir):
    pairs = edges(spark, sf_dir).toDF("light", "heavy")
    return R.echo_counts(pairs, spectra(spark, sf_dir), 1.003355, 5.0)


_WINDOWS = "win AS (SELECT k AS key, k + (k % 3) * 0.25e0 AS target FROM (SELECT unnest(generate_series(1, 500)) AS k))"


@query("jn06_nearest_window", f"WITH {_WINDOWS} SELECT id, key FROM features JOIN win ON abs(target - mz) <= 0.6e0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(target - mz), key DESC) = 1", "features")
def _(spark, sf_dir):
    windows = spark.range(1, 501).select(F.col("id").alias("key"), (F.col("id") + F.col("id") % 3 * 0.25).alias("target"))
    return R.nearest_window(features(spark, sf_dir), windows, 0.6).select("id", "key")


@query("jn07_uncovered", "SELECT id FROM features f WHERE route <> 'P' AND NOT EXISTS (SELECT 1 FROM features p WHERE p.route = 'P' AND p.sample = f.sample AND abs(p.rt - f.rt) <= 5e-2)", "features")
def _(spark, sf_dir):
    f = features(spark, sf_dir)
    return R.uncovered(f.where("route != 'P'"), f.where("route = 'P'"), 0.05).select("id")


@query("jn05_relaxed_nearest", """SELECT o.id, f.id AS peak FROM features o JOIN features f ON o.route = 'O' AND f.route = 'F' AND o.sample = f.sample AND abs(o.rt - f.rt) <= 75e-3 AND abs(o.mz - f.mz) <= 5e0
    QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY abs(o.rt - f.rt), f.id) = 1""", "features")  # fmt: skip
def _(spark, sf_dir):
    f = features(spark, sf_dir)
    peaks = f.where("route = 'F'").select(F.col("id").alias("peak"), F.col("sample").alias("s2"), F.col("rt").alias("rt2"), F.col("mz").alias("mz2"))
    pairs = R.band_join(f.where("route = 'O'"), peaks, "rt", "rt2", 0.075, [("sample", "s2")]).where(F.abs(F.col("mz") - F.col("mz2")) <= 5)
    return R.representatives(pairs, ["id"], [F.abs(F.col("rt") - F.col("rt2")), F.col("peak")]).where("chosen").select("id", "peak")


_LOSS = "loss AS (SELECT unnest([" + ", ".join(f"{m!r}::DOUBLE" for _, m in R.LOSSES) + "]) AS m)"


@query("cl08_loss_consensus", f"""WITH {_LOSS}, c AS (SELECT spec_id, s.mz + m AS cand, s.mz, s.intensity FROM spectra s JOIN orders ON o_orderkey = spec_id CROSS JOIN loss WHERE abs(s.mz + m - floor(o_totalprice / 1000)) <= 5e-1),
    g AS (SELECT *, CASE WHEN cand - lag(cand) OVER w > 1e-2 THEN 1 ELSE 0 END AS jump FROM c WINDOW w AS (PARTITION BY spec_id ORDER BY cand, mz, intensity)), i AS (SELECT *, sum(jump) OVER (PARTITION BY spec_id ORDER BY cand, mz, intensity) AS island FROM g),
    k AS (SELECT spec_id, island, count(DISTINCT round_even(mz * 100, 0)) AS support, sum(intensity) AS mass, sum(cand * intensity) / sum(intensity) AS p FROM i GROUP BY ALL)
    SELECT spec_id, round(p, 6) AS predicted, support, CASE WHEN support >= 3 THEN 'high' WHEN support = 2 THEN 'medium' ELSE 'low' END AS confidence FROM k QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY support DESC, mass DESC, island) = 1""", "spectra")  # fmt: skip
def _(spark, sf_dir):
    channel = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_id"), F.floor(F.col("o_totalprice") / 1000).alias("channel"))
    out = R.loss_consensus(spectra(spark, sf_dir).join(channel, "spec_id"), "channel")
    return out.withColumn("predicted", F.round("predicted", 6))


@query("tk02_pair_dedup", f"""SELECT id FROM features f WHERE NOT EXISTS (SELECT 1 FROM features g WHERE g.sample = f.sample AND abs(g.mz - f.mz) <= {MZ}::DOUBLE AND abs(g.rt - f.rt) <= {RT}::DOUBLE AND (g.height > f.height OR (g.height = f.height AND g.id > f.id)))""", "features")
def _(spark, sf_dir):
    return R.dominated(features(spark, sf_dir), MZ, RT).select("id")


@query("tk06_peak_ownership", """WITH c AS (SELECT *, round_even(mz * 2, 0) AS cell, avg(rt) OVER (PARTITION BY spot) AS centre, count(*) OVER (PARTITION BY spot) AS n FROM features)
    SELECT id FROM c QUALIFY row_number() OVER (PARTITION BY sample, cell ORDER BY round(abs(rt - centre), 6), n DESC, height DESC, id) = 1""", "features")  # fmt: skip
def _(spark, sf_dir):
    own = Window.partitionBy("spot")
    f = features(spark, sf_dir).withColumns({"cell": F.rint(F.col("mz") * 2), "centre": F.avg("rt").over(own), "n": F.count("*").over(own)})
    return R.representatives(f, ["sample", "cell"], [F.round(F.abs(F.col("rt") - F.col("centre")), 6), F.desc("n"), F.desc("height"), F.col("id")]).where("chosen").select("id")


@query("sc14_kovats", """WITH k AS (SELECT DISTINCT CAST(p_size AS DOUBLE) / 2 AS x0 FROM part), n AS (SELECT x0, row_number() OVER (ORDER BY x0) * 100 AS y0 FROM k),
    s AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1, row_number() OVER w = 1 AS first, lead(x0, 2) OVER w IS NULL AS last FROM n WINDOW w AS (ORDER BY x0))
    SELECT id, round(y0 + (y1 - y0) * (rt - x0) / (x1 - x0), 5) AS ri FROM features JOIN s ON x1 IS NOT NULL AND (first OR rt >= x0) AND (last OR rt < x1)""", "features")  # fmt: skip
def _(spark, sf_dir):
    knots = table(spark, sf_dir, "part").select((F.col("p_size").cast("double") / 2).alias("x0")).distinct()
    knots = knots.withColumn("y0", F.row_number().over(Window.orderBy("x0")) * 100)
    return R.interpolate(features(spark, sf_dir), "rt", knots, "ri", 0.5).select("id", F.round("ri", 5).alias("ri"))


@query("prj01_precursor", "SELECT id, coalesce(CASE WHEN route = 'F' THEN mz END, CASE WHEN route = 'O' THEN mz + 0.5e0 END, floor(mz)) AS precursor FROM features", "features")
def _(spark, sf_dir):
    f = features(spark, sf_dir)
    ms1, inferred = F.when(F.col("route") == "F", F.col("mz")), F.when(F.col("route") == "O", F.col("mz") + 0.5)
    return f.select("id", F.coalesce(ms1, inferred, F.floor("mz").cast("double")).alias("precursor"))


@query("prj02_quant_route", """SELECT id, CASE WHEN route = 'P' THEN 'PRODUCT' ELSE 'MS1' END AS quant_route, CASE WHEN route = 'P' THEN r.rep ELSE mz END AS quant_mz, coalesce(CASE WHEN route = 'P' THEN r.rep ELSE mz END, floor(mz)) AS align_mz
    FROM features LEFT JOIN (SELECT spec_id, arg_max(mz, {'i': intensity, 'm': mz}) AS rep FROM spectra GROUP BY 1) r ON r.spec_id = id""", "features spectra")  # fmt: skip
def _(spark, sf_dir):
    from peakloom.operators.spectra import representative_ion

    f = features(spark, sf_dir).join(representative_ion(spectra(spark, sf_dir), ["spec_id"]), F.col("id") == F.col("spec_id"), "left")
    quant = F.when(F.col("route") == "P", F.col("rep_mz")).otherwise(F.col("mz"))
    return f.select("id", F.when(F.col("route") == "P", "PRODUCT").otherwise("MS1").alias("quant_route"), quant.alias("quant_mz"), F.coalesce(quant, F.floor("mz").cast("double")).alias("align_mz"))


@query("flt14_display_filter", "SELECT id, row_number() OVER (ORDER BY route, mz DESC, id) AS place FROM features WHERE route <> 'P' AND contains(lower(sample || ' ' || route), 'urg')", "features")
def _(spark, sf_dir):
    from peakloom.operators import summaries as U

    order = [F.col("route"), F.desc("mz"), F.col("id")]
    return U.display_rows(features(spark, sf_dir), order, hide=F.col("route") == "P", text="Urg", columns=["sample", "route"]).select("id", "place")


@query("flt16_rt_window", "SELECT id FROM features WHERE rt BETWEEN 3 AND 20", "features")
def _(spark, sf_dir):
    from peakloom.operators import summaries as U

    return U.in_rt_window(features(spark, sf_dir), 3.0, 20.0).select("id")


@query("tk10_spot_order", "SELECT id, printf('F%05d', row_number() OVER (ORDER BY mz, rt, id) - 1) AS feature_id FROM features", "features")
def _(spark, sf_dir):
    from peakloom.operators.alignment import number_rows

    return number_rows(features(spark, sf_dir), ["mz", "rt", "id"]).select("id", F.format_string("F%05d", "number").alias("feature_id"))


@query("tk14_sample_ids", "SELECT id, printf('rep%s_%05d', sample, row_number() OVER (PARTITION BY sample ORDER BY mz, rt, id) - 1) AS feature_id FROM features", "features")
def _(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("sample").orderBy("mz", "rt", "id")) - 1
    return features(spark, sf_dir).select("id", F.format_string("rep%s_%05d", "sample", place).alias("feature_id"))


@query("tk12_name_dedup", """WITH n AS (SELECT f.*, c_name || CASE WHEN id % 2 = 0 THEN ' ' ELSE '' END AS name FROM features f JOIN customer ON c_custkey = spot)
    SELECT id, CASE WHEN row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY height DESC, id) = 1 THEN name ELSE 'Putative: ' || name END AS name FROM n""", "features")  # fmt: skip
def _(spark, sf_dir):
    from peakloom.operators.alignment import dedup_names

    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("spot"), "c_name")
    f = features(spark, sf_dir).join(names, "spot").withColumn("name", F.concat("c_name", F.when(F.col("id") % 2 == 0, " ").otherwise("")))
    return dedup_names(f, "height").select("id", "name")
