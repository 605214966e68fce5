"""Operators on ordered series: one chromatogram is one window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["channel"]


def along(keys: list[str] | None = None):
    return Window.partitionBy(*(keys or KEYS)).orderBy("scan")


def tap(column: str, k: int, keys: list[str] | None = None) -> Column:
    """The value ``k`` scans later (earlier if negative), null outside."""
    w = along(keys)
    return F.lead(column, k).over(w) if k > 0 else F.lag(column, -k).over(w) if k < 0 else F.col(column)


def lwma(column: str, level: int, keys: list[str] | None = None) -> Column:
    """Linearly weighted moving average; the weights of taps outside the series are left out."""
    values = [(level + 1 - abs(k), tap(column, k, keys)) for k in range(-level, level + 1)]
    total = sum((w * F.coalesce(v, F.lit(0.0)) for w, v in values[1:]), values[0][0] * F.coalesce(values[0][1], F.lit(0.0)))
    norm = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0) for w, v in values[1:]), F.when(values[0][1].isNotNull(), F.lit(values[0][0])).otherwise(0))
    return total / norm


def lwma_full(column: str, level: int, keys: list[str] | None = None) -> Column:
    """As ``lwma`` with the full norm; taps outside the series read the centre."""
    values = [(level + 1 - abs(k), F.coalesce(tap(column, k, keys), F.col(column))) for k in range(-level, level + 1)]
    return sum((w * v for w, v in values[1:]), values[0][0] * values[0][1]) / ((level + 1) ** 2)


def baseline(series: DataFrame, level: int, wide: int, keys: list[str] | None = None) -> DataFrame:
    """Smoothed signal, wide baseline and the corrected signal, never below 0."""
    out = series.withColumn("once", lwma("intensity", level, keys)).withColumn("signal", lwma("once", level, keys)).withColumn("base", lwma("intensity", wide, keys))
    return out.drop("once").withColumn("corrected", F.greatest(F.col("signal") - F.col("base"), F.lit(0.0)))


def noise_full_bins(series: DataFrame, n_scans: int, column: str = "corrected", keys: list[str] | None = None, size: int = 50, least: int = 10, factor: float = 3.0) -> DataFrame:
    """Median amplitude of the full bins, or 1 with too few of them, times ``factor``."""
    keys = keys or KEYS
    full = series.where(F.col("scan") < n_scans // size * size)
    bins = full.groupBy(*keys, F.floor(F.col("scan") / size).alias("bin")).agg((F.max(column) - F.min(column)).alias("amplitude"))
    middle = F.when(F.count("*") >= least, F.percentile("amplitude", F.lit(0.5))).otherwise(1.0)
    return bins.groupBy(*keys).agg((middle * factor).alias("noise"))


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted array, 0 if it is empty."""
    return F.coalesce(F.try_element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1), F.lit(0.0))


def noise_uneven_bins(series: DataFrame, column: str, keys: list[str] | None = None, size: int = 50, least: int = 10, factor: float = 3.0) -> DataFrame:
    """Upper median amplitude of the bins that are not flat, the last one included; 0 with too few."""
    keys = keys or KEYS
    bins = series.groupBy(*keys, F.floor(F.col("scan") / size).alias("bin")).agg((F.max(column) - F.min(column)).alias("amplitude"))
    grouped = bins.groupBy(*keys).agg(F.collect_list(F.when(F.col("amplitude") > 0, F.col("amplitude"))).alias("a"))
    noise = F.when(F.size("a") >= least, upper_median(F.col("a")) * factor).otherwise(0.0)
    return grouped.select(*keys, noise.alias("noise"), F.greatest(F.lit(1.0), noise / factor).alias("estimated"))


FIRST, SECOND = (-0.2, -0.1, 0.0, 0.1, 0.2), (0.14285714, -0.07142857, -0.1428571, -0.07142857, 0.14285714)


def derivatives(series: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """First and second derivative over five points, 0 within two scans of an end."""

    def stencil(weights: tuple[float, ...]) -> Column:
        values = [w * tap(column, k - 2, keys) for k, w in enumerate(weights)]
        return F.coalesce(values[0] + values[1] + values[2] + values[3] + values[4], F.lit(0.0))

    return series.withColumns({"d1": stencil(FIRST), "d2": stencil(SECOND)})


def slope_noises(series: DataFrame, column: str, keys: list[str] | None = None, part: float = 0.05) -> DataFrame:
    """Upper medians of the small differences, first and (negative) second derivatives; 1e-4 where there are none."""
    keys = keys or KEYS
    steps = derivatives(series, column, keys).withColumns({"back": F.abs(F.col(column) - tap(column, -1, keys)), "ahead": F.abs(tap(column, 1, keys) - F.col(column))})
    steps = steps.withColumns({"slope": F.abs("d1"), "bend": F.when(F.col("d2") < 0, -F.col("d2"))})
    tops = steps.groupBy(*keys).agg(F.max("back").alias("t0"), F.max("slope").alias("t1"), F.max("bend").alias("t2"))
    joined = steps.join(tops, keys)
    small = lambda value, top: F.collect_list(F.when((F.col(value) > 0) & (F.col(value) < F.col(top) * part), F.col(value)))
    lists = joined.groupBy(*keys).agg(small("ahead", "t0").alias("a"), small("slope", "t1").alias("s"), small("bend", "t2").alias("p"))
    middle = lambda c: F.when(F.size(c) > 0, upper_median(F.col(c))).otherwise(1e-4)
    return lists.select(*keys, middle("a").alias("amplitude_noise"), middle("s").alias("slope_noise"), middle("p").alias("peaktop_noise"))


def shape_flags(series: DataFrame, column: str = "intensity", keys: list[str] | None = None, flat: float = 1.0) -> DataFrame:
    """Local tests on the curve: top, large top, broad top, flat, bottom, large bottom and broad bottom."""
    x = {k: tap(column, k, keys) for k in range(-2, 3)}
    rise, fall = lambda a, b: x[a] <= x[b], lambda a, b: x[a] >= x[b]
    flags = {
        "top": (x[-1] <= x[0]) & (x[0] >= x[1]),
        "large_top": rise(-2, -1) & rise(-1, 0) & fall(0, 1) & fall(1, 2),
        "broad_top": (rise(-2, -1) & rise(-1, 0) & fall(0, 1)) | (rise(-1, 0) & fall(0, 1) & fall(1, 2)),
        "flat": (F.abs(x[-1] - x[0]) < flat) & (F.abs(x[0] - x[1]) < flat),
        "bottom": (x[-1] >= x[0]) & (x[0] <= x[1]),
        "large_bottom": fall(-2, -1) & fall(-1, 0) & rise(0, 1) & rise(1, 2),
        "broad_bottom": (fall(-2, -1) & fall(-1, 0) & rise(0, 1)) | (fall(-1, 0) & rise(0, 1) & rise(1, 2)),
    }
    return series.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def local_peaks(series: DataFrame, column: str, keys: list[str] | None = None, share: float = 0.05) -> DataFrame:
    """Strict local maxima with the nearest stop on either side.

    A side stops at the nearest valley (a scan lower than the next one towards the peak's far side) or at the
    nearest scan below ``share`` of the apex, whichever is closer, or at the end of the series.
    """
    keys = keys or KEYS
    w = along(keys)
    around = series.withColumns({"prev": F.lag(column).over(w), "next": F.lead(column).over(w)})
    apex = around.where((F.col(column) > F.col("prev")) & (F.col(column) >= F.col("next"))).select(*keys, F.col("scan").alias("apex"), F.col(column).alias("height"))
    low = around.where((F.col(column) <= F.col("prev")) & (F.col(column) < F.col("next")) | F.col("prev").isNull() | F.col("next").isNull())
    rows = around.select(*keys, "scan", F.col(column).alias("v"))
    marks = rows.join(low.select(*keys, "scan", F.lit(True).alias("valley")), [*keys, "scan"], "left")
    before = F.max(F.when(F.col("valley"), F.col("scan"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("valley"), F.col("scan"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    bounds = marks.select(*keys, F.col("scan").alias("apex"), before.alias("left"), after.alias("right"))
    found = apex.join(bounds, [*keys, "apex"])
    inside = rows.join(found, keys).where((F.col("scan") >= F.col("left")) & (F.col("scan") <= F.col("right")) & (F.col("v") < F.col("height") * share))
    near = inside.groupBy(*keys, "apex").agg(F.max(F.when(F.col("scan") < F.col("apex"), F.col("scan"))).alias("low_left"), F.min(F.when(F.col("scan") > F.col("apex"), F.col("scan"))).alias("low_right"))
    cut = found.join(near, [*keys, "apex"], "left")
    return cut.select(*keys, "apex", "height", F.greatest("left", "low_left").alias("left"), F.least("right", "low_right").alias("right"))


def longest_run(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Longest run of scans above 0 and the share of scans at 0."""
    keys = keys or KEYS
    block = F.col("scan") - F.row_number().over(Window.partitionBy(*keys).orderBy("scan"))
    alive = series.where("intensity > 0").withColumn("block", block).groupBy(*keys, "block").agg(F.count("*").alias("n"))
    runs = alive.groupBy(*keys).agg(F.max("n").alias("longest"))
    zero = series.groupBy(*keys).agg((F.count_if(F.col("intensity") <= 0) / F.count("*")).alias("zero_share"))
    return zero.join(runs, keys, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def gaussian_fit(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson correlation of each peak's points with the gaussian of its own moments, from 0 to 1."""
    moments = peaks.groupBy(*keys).agg((F.sum(F.col("scan") * F.col("intensity")) / F.sum("intensity")).alias("mu"), F.sum("intensity").alias("mass"))
    centred = peaks.join(moments, keys)
    spread = centred.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col("scan") - F.col("mu"), 2) * F.col("intensity")) / F.first("mass")).alias("sd"))
    model = centred.join(spread, keys).withColumn("model", F.exp(-0.5 * F.pow((F.col("scan") - F.col("mu")) / F.col("sd"), 2)))
    stats = model.where("sd > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("intensity", "model").alias("c"), F.stddev_pop("intensity").alias("a"), F.stddev_pop("model").alias("b"))
    similarity = F.when((F.col("n") >= 4) & (F.col("a") > 0) & (F.col("b") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c") / F.col("a") / F.col("b")))).otherwise(0.0)
    return stats.select(*keys, similarity.alias("similarity"))


def matched_filter(column: str, sigma: float = 0.5, half: int = 10, keys: list[str] | None = None) -> Column:
    """Second-derivative-of-gaussian filter; taps outside the series count 0."""
    import math

    taps = [(1 - (k / sigma) ** 2) * math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    values = [w * F.coalesce(tap(column, k - half, keys), F.lit(0.0)) for k, w in enumerate(taps)]
    return sum(values[1:], values[0])


def deskew(series: DataFrame, shift: float, column: str = "intensity", keys: list[str] | None = None) -> DataFrame:
    """The curve moved by ``shift`` scans along the parabola through each three neighbours; the ends stay."""
    a, b, c = (tap(column, k, keys) for k in (-1, 0, 1))
    moved = b + (c - a) / 2 * shift + (a - 2 * b + c) / 2 * shift * shift
    return series.withColumn("deskewed", F.when(a.isNull() | c.isNull(), b).otherwise(F.greatest(moved, F.lit(0.0))))


def pearson_pairs(series: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Correlation of each two series over scans where both are above 0; 0 if constant or too short."""
    alive = series.where("intensity > 0")
    left = alive.select(F.col(keys[0]).alias("a"), "scan", F.col("intensity").alias("x"))
    right = alive.select(F.col(keys[0]).alias("b"), "scan", F.col("intensity").alias("y"))
    both = left.join(right, "scan").where("a < b")
    stats = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r = F.when((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / F.col("sx") / F.col("sy")).otherwise(0.0)
    return stats.select("a", "b", "n", r.alias("pearson"))


def coelutes(n: Column, pearson: Column, floor: Column, limit: float = 0.9) -> Column:
    """Enough jointly positive points and a high enough correlation."""
    return (n >= floor) & (pearson >= limit)


def shape_scores(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Sharpness and ideal slope of each peak (``at``, intensity): the apex is the first greatest point.

    Sharpness is the mean over the sides of the steepest drop a scan by the root of the apex; peaks without a side
    are left out.
    """
    own = Window.partitionBy(*keys)
    top = F.max(F.struct("intensity", (-F.col("at")).alias("back"))).over(own)
    p = peaks.withColumns({"__top": top, "__step": F.lead("intensity").over(own.orderBy("at")) - F.col("intensity")})
    p = p.withColumns({"__apex": -F.col("__top.back"), "__height": F.col("__top.intensity")})
    drop = (F.col("__height") - F.col("intensity")) / F.nullif(F.abs(F.col("at") - F.col("__apex")), F.lit(0)) / F.sqrt("__height")
    before = F.col("at") < F.col("__apex")
    towards = F.when(before, F.col("__step")).otherwise(-F.col("__step"))
    zero = F.lit(0.0)
    sums = p.withColumns({"__drop": drop, "__towards": towards}).groupBy(*keys).agg(
        F.max(F.when(before, F.col("__drop"))).alias("l"), F.max(F.when(F.col("at") > F.col("__apex"), F.col("__drop"))).alias("r"),
        F.sum(F.greatest("__towards", zero)).alias("good"), F.sum(F.greatest(-F.col("__towards"), zero)).alias("bad"),
    )
    ideal = F.when(F.col("good") > 0, F.greatest(zero, (F.col("good") - F.col("bad")) / F.col("good"))).otherwise(zero)
    return sums.where("l IS NOT NULL AND r IS NOT NULL").select(*keys, ((F.col("l") + F.col("r")) / 2).alias("shapeness"), ideal.alias("ideal_slope"))


def parabola_apexes(series: DataFrame, column: str = "intensity", keys: list[str] | None = None) -> DataFrame:
    """Strict maxima with the vertex of the parabola through three points, at most half a scan off."""
    a, c = tap(column, -1, keys), tap(column, 1, keys)
    three = series.withColumns({"__a": a, "__c": c}).where((F.col(column) > F.col("__a")) & (F.col(column) > F.col("__c")))
    shift = (F.col("__a") - F.col("__c")) / (2 * (F.col("__a") - 2 * F.col(column) + F.col("__c")))
    return three.withColumn("apex", F.col("scan") + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), shift))).drop("__a", "__c")
