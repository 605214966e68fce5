"""Range joins, nearest joins and islands as equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.session import materialize


def box_join(left: DataFrame, right: DataFrame, bands: list[tuple[str, str, float | Column]], on: list[tuple[str, str]] | None = None, how: str = "inner", widths: list[float] | None = None, parts: int | None = None) -> DataFrame:
    """Pairs that are within the tolerance in every band (left column, right column, tolerance) and equal in the ``on`` columns.

    Each band is cut into cells ``widths`` wide (four tolerances by default, so that most right rows lie in one or two). A left row is in one cell of
    the box, a right row in all that its tolerances reach; so the join is an equi-join on the cells of all bands with a residual
    test. A tolerance may be a column of the right side if its width is given. Column names must differ. ``parts`` deals both sides to
    so many parts by cell, which Spark does not coalesce: for joins that return far more than they read.
    """
    lefts, rights, test = left, right, F.lit(True)
    for i, (x, y, tolerance) in enumerate(bands):
        wide = widths[i] if widths else max(4 * tolerance, 1e-9)
        reach = (F.lit(tolerance) if isinstance(tolerance, (int, float)) else tolerance) * (1 + 1e-9) + F.abs(F.col(y)) * 1e-12  # rounding must lose no pair
        cell = lambda v, wide=wide: F.floor(v / wide).cast("long")
        lefts = lefts.withColumn(f"__b{i}", cell(F.col(x)))
        rights = rights.withColumn(f"__c{i}", F.explode(F.sequence(cell(F.col(y) - reach), cell(F.col(y) + reach))))
        test = test & (F.col(f"__b{i}") == F.col(f"__c{i}")) & (F.abs(F.col(x) - F.col(y)) <= tolerance)
    for a, b in on or []:
        test = test & (F.col(a) == F.col(b))
    if parts:
        lefts = lefts.repartition(parts, *[f"__b{i}" for i in range(len(bands))], *[a for a, _ in on or []])
        rights = rights.repartition(parts, *[f"__c{i}" for i in range(len(bands))], *[b for _, b in on or []])
    return lefts.join(rights, test, how).drop(*(f"__{c}{i}" for c in "bc" for i in range(len(bands))))


def band_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tolerance: float, on: list[tuple[str, str]] | None = None, how: str = "inner") -> DataFrame:
    """Pairs with ``abs(left_key - right_key) <= tolerance`` (and equal ``on`` columns), by ``box_join``."""
    return box_join(left, right, [(left_key, right_key, tolerance)], on, how)


def nearest_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tolerance: float, keys: list[str], ties: list[Column], on: list[tuple[str, str]] | None = None) -> DataFrame:
    """For each left row (identified by ``keys``) the nearest right row in the band, ties by ``ties``."""
    pairs = band_join(left, right, left_key, right_key, tolerance, on)
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col(left_key) - F.col(right_key)), *ties)
    return pairs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def spread_out(rows: DataFrame, keys: list[str], least: int = 4_000_000) -> DataFrame:
    """Rows by hash of the keys, in as many parts as the plan's size has ``least`` bytes, where that is more than there are cores.

    Windows over the keys then sort parts of a bounded size, which Spark does not coalesce; each further one on them is in the same parts.
    """
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(-(-size // least), 20_000)
    return rows.repartition(parts, *keys) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def alike(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row for all that are equal in every column but ``key``, with their keys in order as the array ``name``."""
    return rows.groupBy(*[c for c in rows.columns if c != key]).agg(F.sort_array(F.collect_list(key)).alias(name))


def class_pairs(rows: DataFrame, key: str, bands: list[tuple[str, str, float]], on: list[str], told: dict[str, Column], test: Column | None = None) -> DataFrame:
    """Ordered pairs of the table's rows in a box (see ``box_join``), as their keys and what is ``told`` of them; columns are suffixed _a and _b.

    Rows equal in all but the key are written and joined once, as a class with its keys: ``test`` and ``told`` may not look at the keys, and are
    worked out once for all pairs of two classes. These leave one after another, by key a and key b, so that written columns hold long runs.
    Only classes are shuffled, to parts of about 250 KB, so that the keys of a part mostly fit a Parquet dictionary. A pair of classes is in one task; a row pairs with itself too.
    """
    classes = materialize(alike(rows, key, "keys"), "classes")
    size = int(classes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, min(-(-size // 250_000), 20_000))
    left, right = (classes.select(*[F.col(c).alias(f"{c}_{s}") for c in classes.columns]) for s in "ab")
    pairs = box_join(left, right, bands, [(f"{c}_a", f"{c}_b") for c in on], widths=[2 * t for _, _, t in bands], parts=parts)
    pairs = (pairs if test is None else pairs.where(test)).select("keys_a", "keys_b", *[c.alias(n) for n, c in told.items()])
    return pairs.select(F.explode("keys_a").alias(f"{key}_a"), "keys_b", *told).select(f"{key}_a", F.explode("keys_b").alias(f"{key}_b"), *told)


def islands(rows: DataFrame, groups: list[str], order: list[str], gap: float, name: str = "island") -> DataFrame:
    """Number the runs of each group whose neighbours in ``order[0]`` are at most ``gap`` apart, from 0.

    Rows that are equal in all of ``order`` are peers and share a run. A group is sorted in one task: it is to be bounded, as a spectrum or a
    component is.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    jump = (F.col(order[0]) - F.lag(order[0]).over(window) > gap).cast("int")
    running = F.sum("__jump").over(window)
    return rows.withColumn("__jump", F.coalesce(jump, F.lit(0))).withColumn(name, running).drop("__jump")


def top_k(rows: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group under a total order, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)
