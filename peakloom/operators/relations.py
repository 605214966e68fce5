"""Relations between features of one sample: isotopes, adducts, duplicates, fragments, windows and masses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.plans.bands import band_join, box_join, class_pairs, islands, nearest_join
from peakloom.plans.graph import connected_components
from peakloom.session import materialize

# Masses in Da.
PROTON, WATER, FORMIC, ACETIC = 1.00727646677, 18.01056468, 46.00547984, 60.02112937
ISOTOPES = (("C13", 1.003355), ("N15", 0.997035), ("S34", 1.995796), ("O18", 2.004245), ("Cl37", 1.997050), ("Br81", 1.997953))
#: Name, mass added, charge and multiplier of each adduct, in order of preference.
POSITIVE = (
    ("[M+H]+", PROTON, 1, 1), ("[M+Na]+", 22.989218, 1, 1), ("[M+K]+", 38.963158, 1, 1), ("[M+NH4]+", 18.033826, 1, 1),
    ("[M+H-H2O]+", PROTON - WATER, 1, 1), ("[M+2H]2+", 2 * PROTON, 2, 1), ("[2M+H]+", PROTON, 1, 2), ("[2M+Na]+", 22.989218, 1, 2),
)
NEGATIVE = (
    ("[M-H]-", -PROTON, 1, 1), ("[M+Cl]-", 34.969402, 1, 1), ("[M+FA-H]-", FORMIC - PROTON, 1, 1), ("[M+HAc-H]-", ACETIC - PROTON, 1, 1),
    ("[M-H2O-H]-", -PROTON - WATER, 1, 1), ("[M-2H]2-", -2 * PROTON, 2, 1), ("[2M-H]-", -PROTON, 1, 2),
)
# Common neutral losses; CH3OH and CH4O are one mass that is listed twice.
LOSSES = (
    ("H", 1.00783), ("H2", 2.01565), ("H2O", 18.01056), ("2H2O", 36.02113), ("NH3", 17.02655), ("CO", 27.99491), ("HCN", 27.01090), ("CH2O", 30.01056),
    ("CO2", 43.98983), ("C2H2O", 42.01057), ("CH3", 15.02348), ("C2H4", 28.03130), ("C2H2", 26.01565), ("CHO2", 44.99765), ("C3H6", 42.04695),
    ("CH3OH", 32.02621), ("C2H4O", 44.02621), ("CH2O2", 46.00548), ("C2H5", 29.03913), ("C3H4", 40.03130), ("NH2", 16.01872), ("NO", 29.99799),
    ("NO2", 45.99290), ("HCl", 35.97668), ("SO2", 63.96190), ("SO3", 79.95682), ("C2H3N", 41.02655), ("C3H3N", 53.02655), ("C4H8", 56.06260), ("CH4O", 32.02621),
)


def neutral_mass(mz: Column, added: Column | float, charge: Column | int, multiplier: Column | int) -> Column:
    return (mz * charge - added) / multiplier


def adduct_table(mode: str = "positive") -> Column:
    """The adducts as an array of structs, a constant of the plan."""
    rows = POSITIVE if mode == "positive" else NEGATIVE
    return F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("adduct"), F.lit(float(m)).alias("added"), F.lit(c).alias("charge"), F.lit(k).alias("multiplier")) for i, (n, m, c, k) in enumerate(rows)])


def neutral_masses(features: DataFrame, mode: str = "positive") -> DataFrame:
    """Each feature under each adduct, with the neutral mass that it implies."""
    spread = features.withColumn("a", F.explode(adduct_table(mode)))
    return spread.select(*features.columns, "a.place", "a.adduct", neutral_mass(F.col("mz"), F.col("a.added"), F.col("a.charge"), F.col("a.multiplier")).alias("mass"))


def pair_edges(features: DataFrame, mz_tolerance: float, rt_tolerance: float, **told: Column) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of one sample that are close in m/z and RT, and what is ``told`` of them.

    ``told`` is made of the features' columns, suffixed _a and _b, but for the ids. Only columns that it needs are to be given: features equal
    in all others are joined once.
    """
    return class_pairs(features, "id", [("mz_a", "mz_b", mz_tolerance), ("rt_a", "rt_b", rt_tolerance)], ["sample"], told).where("id_a < id_b")


def gap_class(delta: Column, classic: float = 0.01, relaxed: float = 0.02, most: int = 4) -> Column:
    """classic for an element's isotope step (carbon up to ``most`` steps), relaxed for a whole number, else null."""
    near = lambda xs, tol: F.least(*[F.abs(delta - float(x)) for x in xs]) <= tol
    return F.when(near(isotope_steps(most), classic), "classic").when(near(range(1, most + 1), relaxed), "relaxed")


def isotope_steps(most: int = 4) -> list[float]:
    return [n * ISOTOPES[0][1] for n in range(1, most + 1)] + [d for _, d in ISOTOPES[1:]]


def nearest_step(delta: Column, most: int = 4) -> Column:
    """The isotope step nearest to a difference, the earlier one on ties."""
    steps = [float(s) for s in isotope_steps(most)]
    nearest = F.least(*[F.abs(delta - s) for s in steps])
    return F.coalesce(*[F.when(F.abs(delta - s) == nearest, s) for s in steps])


def isotope_pairs(features: DataFrame, least: float, most: float, rt_tolerance: float) -> DataFrame:
    """(a, b, gap, step) of all pairs of one sample whose b is ``least`` to ``most`` above a in m/z, at about the same time."""
    rows = features.select("id", "sample", "mz", "rt", (F.col("mz") + (least + most) / 2).alias("goal"))
    delta = F.col("mz_b") - F.col("mz_a")
    bands = [("goal_a", "mz_b", (most - least) * 0.55), ("rt_a", "rt_b", rt_tolerance)]  # a tenth beyond, as the test is on the difference
    pairs = class_pairs(rows, "id", bands, ["sample"], {"gap": gap_class(delta), "step": nearest_step(delta)}, delta.between(least, most))
    return pairs.where("id_a != id_b").withColumnsRenamed({"id_a": "a", "id_b": "b"})


def carbon_ratio_limit(mz: Column) -> Column:
    """Highest plausible M+1 to M ratio: a carbon for each 12 Da, 1.1 % each."""
    return mz / 12 * 0.011


def overlap_ratio(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """Shared length over that of the narrower peak, 0 to 1."""
    shared = F.greatest(F.lit(0.0), F.least(right_a, right_b) - F.greatest(left_a, left_b))
    narrow = F.least(right_a - left_a, right_b - left_b)
    return F.when(narrow > 0, F.least(F.lit(1.0), shared / narrow)).otherwise(0.0)


def isotope_edges(features: DataFrame, rt_tolerance: float, classic: float = 0.01, relaxed: float = 0.02, most: int = 4) -> DataFrame:
    """(light, heavy, gap, step) of pairs an isotope step apart whose heavy side is not too strong.

    Each feature is sent to the masses of its steps, so that the join's box is as narrow as the tolerances in mass and RT.
    """
    steps = F.array(*[F.lit(n * ISOTOPES[0][1]) for n in range(1, most + 1)], *[F.lit(d) for _, d in ISOTOPES[1:]], *[F.lit(float(n)) for n in range(1, most + 1)])
    light = features.select(F.col("id").alias("light"), "sample", F.col("mz").alias("mz_light"), F.col("rt").alias("rt_light"), F.col("height").alias("height_light"), F.explode(steps).alias("step"))
    light = light.withColumn("goal", F.col("mz_light") + F.col("step"))
    heavy = features.select(F.col("id").alias("heavy"), F.col("sample").alias("sample_heavy"), F.col("mz").alias("mz_heavy"), F.col("rt").alias("rt_heavy"), F.col("height").alias("height_heavy"))
    pairs = box_join(light, heavy, [("goal", "mz_heavy", max(classic, relaxed) + 1e-9), ("rt_light", "rt_heavy", rt_tolerance)], [("sample", "sample_heavy")])
    delta = F.col("mz_heavy") - F.col("mz_light")
    reached = F.filter(steps, lambda s: F.abs(F.col("mz_light") + s - F.col("mz_heavy")) <= max(classic, relaxed) + 1e-9)
    pairs = pairs.where(F.col("step") == F.get(reached, F.lit(0)))  # a pair that several steps reach is taken at the first
    pairs = pairs.withColumns({"gap": gap_class(delta, classic, relaxed, most), "nearest": nearest_step(delta, most)})
    carbon = F.abs(delta - ISOTOPES[0][1]) <= relaxed
    plausible = ~carbon | (F.col("height_heavy") <= F.col("height_light") * F.greatest(F.lit(1.0), carbon_ratio_limit(F.col("mz_light")) * 2))
    return pairs.where(F.col("gap").isNotNull() & plausible).select("light", "heavy", "gap", F.col("nearest").alias("step"))


def adduct_edges(features: DataFrame, rt_tolerance: float, mass_tolerance: float = 0.02, mode: str = "positive") -> DataFrame:
    """(a, b, adduct_a, adduct_b) of pairs of one sample whose masses agree under some two adducts; the first two in table order."""
    masses = neutral_masses(features.select("id", "sample", "mz", "rt"), mode)
    left = masses.select(*[F.col(c).alias(f"{c}_a") for c in masses.columns])
    right = masses.select(*[F.col(c).alias(f"{c}_b") for c in masses.columns])
    pairs = box_join(left, right, [("mass_a", "mass_b", mass_tolerance), ("rt_a", "rt_b", rt_tolerance)], [("sample_a", "sample_b")])
    pairs = pairs.where((F.col("id_a") < F.col("id_b")) & (F.col("place_a") != F.col("place_b")))
    table = adduct_table(mode)
    earlier = lambda x, y: (x["place"] < F.col("place_a")) | ((x["place"] == F.col("place_a")) & (y["place"] < F.col("place_b")))
    mass = lambda mz, x: neutral_mass(F.col(mz), x["added"], x["charge"], x["multiplier"])
    agree = lambda x, y: (x["place"] != y["place"]) & earlier(x, y) & (F.abs(mass("mz_a", x) - mass("mz_b", y)) <= mass_tolerance)
    first = ~F.exists(table, lambda x: F.exists(table, lambda y: agree(x, y)))  # a pair that agrees under several adducts is taken at the first two
    return pairs.where(first).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "adduct_a", "adduct_b")


def fragment_parents(features: DataFrame, peaks: DataFrame, rt_tolerance: float, mz_tolerance: float) -> DataFrame:
    """(child, parent): the parent of least m/z above the child's whose spectrum holds the child's ion at about the same time."""
    kids = features.select(F.col("id").alias("child"), "sample", F.col("mz").alias("mz_child"), F.col("rt").alias("rt_child"))
    ions = peaks.select(F.col("spec_id").alias("parent"), F.col("mz").alias("ion"))
    parents = features.select(F.col("id").alias("parent"), F.col("sample").alias("sample_p"), F.col("mz").alias("mz_parent"), F.col("rt").alias("rt_parent")).join(ions, "parent")
    pairs = box_join(kids, parents, [("mz_child", "ion", mz_tolerance), ("rt_child", "rt_parent", rt_tolerance)], [("sample", "sample_p")])
    pairs = pairs.where(F.col("mz_parent") > F.col("mz_child"))
    return pairs.groupBy("child").agg(F.min(F.struct("mz_parent", "parent"))["parent"].alias("parent"))


def echo_counts(pairs: DataFrame, peaks: DataFrame, delta: float, tolerance: float, top: int = 6) -> DataFrame:
    """(light, heavy, matched, considered): how many of the light spectrum's ``top`` ions return ``delta`` higher in the heavy one."""
    rank = F.row_number().over(Window.partitionBy("spec_id").orderBy(F.desc("intensity"), "mz"))
    strong = peaks.withColumn("r", rank).where(F.col("r") <= top).select(F.col("spec_id").alias("light"), "r", (F.col("mz") + delta).alias("goal"))
    other = peaks.select(F.col("spec_id").alias("heavy"), F.col("mz").alias("mz_heavy"))
    both = pairs.select("light", "heavy").join(strong, "light").join(other, "heavy")
    hits = both.groupBy("light", "heavy", "r").agg(F.max(F.abs(F.col("goal") - F.col("mz_heavy")) <= tolerance).alias("hit"))
    return hits.groupBy("light", "heavy").agg(F.count_if("hit").alias("matched"), F.count("*").alias("considered"))


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``root``, the smallest id that a node reaches over edges (a, b)."""
    roots = connected_components(edges.select("a", "b"))
    return nodes.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")


def isotope_links(features: DataFrame, rt_tolerance: float) -> DataFrame:
    """Edges (a, b) with the components of ``isotope_edges``: features equal in all that an edge looks at are told once, and tied to the first of them if it has an edge."""
    same = ["sample", "mz", "rt", "height"]
    first = features.groupBy(*same).agg(F.min("id").alias("id"))
    edges = materialize(isotope_edges(first, rt_tolerance).select(F.col("light").alias("a"), F.col("heavy").alias("b")), "isotope-links")
    linked = first.join(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "first")
    twins = features.select(*same, "id").join(linked, same).where("id != first")
    return edges.unionByName(twins.select(F.col("first").alias("a"), F.col("id").alias("b")))


def split_at_gaps(labelled: DataFrame, gap: float) -> DataFrame:
    """Number the parts of each component that RT gaps above ``gap`` set apart, as ``part``."""
    return islands(labelled, ["root"], ["rt", "id"], gap, "part")


def representatives(labelled: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add ``chosen``: whether the row is the first of its group."""
    return labelled.withColumn("chosen", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def nearest_window(features: DataFrame, windows: DataFrame, tolerance: float) -> DataFrame:
    """The isolation window (key, target) nearest to each feature, the later key on ties; features out of reach are left out."""
    return nearest_join(features, windows, "mz", "target", tolerance, ["id"], [F.desc("key")])


def uncovered(features: DataFrame, cover: DataFrame, rt_tolerance: float) -> DataFrame:
    """Features without a covering row of the same sample within the RT tolerance."""
    other = cover.select(F.col("sample").alias("sample_c"), F.col("rt").alias("rt_c"))
    return band_join(features, other, "rt", "rt_c", rt_tolerance, [("sample", "sample_c")], "left_anti")


def loss_consensus(peaks: DataFrame, channel: str, gap: float = 0.01, reach: float = 0.5) -> DataFrame:
    """Precursor m/z implied by common losses: the chain of candidates with most fragments, then most intensity.

    ``peaks`` has spec_id, mz, intensity and the channel. Returns spec_id, predicted, support and confidence.
    """
    losses = F.array(*[F.lit(m) for _, m in LOSSES])
    cand = peaks.withColumn("cand", F.explode(F.transform(losses, lambda m: F.col("mz") + m)))
    cand = cand.where(F.abs(F.col("cand") - F.col(channel)) <= reach).select("spec_id", "cand", "mz", "intensity")
    chained = islands(cand, ["spec_id"], ["cand", "mz", "intensity"], gap)
    groups = chained.groupBy("spec_id", "island").agg(
        F.count_distinct(F.rint(F.col("mz") * 100)).alias("support"), F.sum("intensity").alias("mass"), (F.sum(F.col("cand") * F.col("intensity")) / F.sum("intensity")).alias("predicted")
    )
    best = representatives(groups, ["spec_id"], [F.desc("support"), F.desc("mass"), F.col("island")]).where("chosen")
    level = F.when(F.col("support") >= 3, "high").when(F.col("support") == 2, "medium").otherwise("low")
    return best.select("spec_id", "predicted", "support", level.alias("confidence"))


def dominated(features: DataFrame, mz_tolerance: float, rt_tolerance: float) -> DataFrame:
    """Features that no close one beats: a taller one does, of equal height the later id."""
    other = features.select(F.col("sample").alias("s2"), F.col("id").alias("id2"), F.col("mz").alias("mz2"), F.col("rt").alias("rt2"), F.col("height").alias("h2"))
    beats = (F.col("h2") > F.col("height")) | ((F.col("h2") == F.col("height")) & (F.col("id2") > F.col("id")))
    pairs = box_join(features, other, [("mz", "mz2", mz_tolerance), ("rt", "rt2", rt_tolerance)], [("sample", "s2")])
    beaten = pairs.where(beats).select("sample", "id").distinct()
    return features.join(beaten, ["sample", "id"], "left_anti").select(*features.columns)


def interpolate(rows: DataFrame, x: str, knots: DataFrame, name: str, width: float) -> DataFrame:
    """Piecewise linear map through knots (x0, y0), carried on beyond the first and last two.

    Segments are repeated in the cells of ``width`` that they cover, so that the lookup is an equi-join.
    """
    order = Window.orderBy("x0")
    segments = knots.withColumns({"x1": F.lead("x0").over(order), "y1": F.lead("y0").over(order), "first": F.row_number().over(order) == 1, "last": F.lead("x0", 2).over(order).isNull()}).where("x1 IS NOT NULL")
    ends = rows.agg(F.floor(F.min(x) / width).alias("low"), F.floor(F.max(x) / width).alias("high"))
    segments = segments.crossJoin(F.broadcast(ends))  # one row
    begin = F.when(F.col("first"), F.least("low", F.floor(F.col("x0") / width))).otherwise(F.floor(F.col("x0") / width))
    end = F.when(F.col("last"), F.greatest("high", F.floor(F.col("x1") / width))).otherwise(F.floor(F.col("x1") / width))
    cells = segments.withColumn("__cell", F.explode(F.sequence(begin, end)))
    inside = (F.col("first") | (F.col(x) >= F.col("x0"))) & (F.col("last") | (F.col(x) < F.col("x1")))
    joined = rows.join(cells, (F.floor(F.col(x) / width) == F.col("__cell")) & inside, "left")
    value = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return joined.withColumn(name, value).drop("x0", "y0", "x1", "y1", "first", "last", "low", "high", "__cell")
