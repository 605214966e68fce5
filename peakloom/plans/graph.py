"""Connected components of an edge table as iterated joins, and blocks of linked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.session import materialize, release


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Label the nodes of ``edges`` (columns a, b) with the smallest node they reach.

    Returns (node, root) for every node that has an edge to another one. Large-star and small-star rounds
    alternate until the edges no longer change; each round is written to the shared folder, so that the
    lineage stays short and lost executors cost one round at most. The minimum of a hub's neighbours is
    pre-aggregated in each task, and the join that hands it out is one that Spark can split by skew.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).hint("rebalance")
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", "m")).toDF("a", "b")
        small = small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        before, now = now, materialize(small, "edges")
        release(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def linked_blocks(rows: DataFrame, node: Column, edges: DataFrame, name: str = "block") -> DataFrame:
    """Add ``name``: the component of each row in the graph of ``edges`` (a, b) between nodes, its own node where it has no edge.

    Steps that depend on order look at linked rows only, so they can run on each block by itself.
    """
    roots = connected_components(edges)
    named = rows.withColumn("__node", node)
    return named.join(roots, F.col("__node") == F.col("node"), "left").withColumn(name, F.coalesce("root", "__node")).drop("node", "root", "__node")


def near_blocks(rows: DataFrame, node: Column, keys: list[str], x: str, y: str, wide: float, high: float, name: str = "block") -> DataFrame:
    """Add ``name``: the smallest node that chains of pairs of equal ``keys``, at most ``wide`` apart in ``x`` and ``high`` in ``y``, reach from the row.

    Pairs are not made. Rows of one cell, as wide and as high as the tolerances, are linked anyway; two cells are linked if any two of their rows are,
    and for that only rows that no other of the cell precedes in both directions towards the other cell need to be looked at.
    """
    cells = [*keys, "__i", "__j"]
    cell = lambda c, width: F.floor(F.col(c) / (width * (1 - 1e-6))).cast("long")
    named = rows.withColumn("__node", node)
    spots = named.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"), cell(x, wide).alias("__i"), cell(y, high).alias("__j"), "__node")
    spots = materialize(spots.groupBy(*cells, "__x", "__y").agg(F.min("__node").alias("__node")), "spots")  # copies are told once
    heads = materialize(spots.groupBy(*cells).agg(F.min("__node").alias("__head")), "heads")

    def edge(right: bool, top: bool) -> DataFrame:
        """Rows of each cell that no other is both further right (or left) and further up (or down) than."""
        order = [F.col("__x").desc() if right else F.col("__x").asc(), F.col("__y").desc() if top else F.col("__y").asc()]
        before = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        best = (F.max if top else F.min)("__y").over(before)
        return spots.withColumn("__best", best).where(F.col("__best").isNull() | (F.col("__y") > F.col("__best") if top else F.col("__y") < F.col("__best"))).select(*cells, "__x", "__y")

    def across(near: DataFrame, far: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
        step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
        there = near.withColumn("__s", F.explode(step)).select(*keys, (F.col("__i") + F.col("__s.i")).alias("__i"), (F.col("__j") + F.col("__s.j")).alias("__j"), F.col("__i").alias("__i0"), F.col("__j").alias("__j0"), F.col("__x").alias("__x0"), F.col("__y").alias("__y0"))
        met = there.join(far, cells).where((F.abs(F.col("__x") - F.col("__x0")) <= wide) & (F.abs(F.col("__y") - F.col("__y0")) <= high))
        return met.select(*cells, "__i0", "__j0").distinct()

    up = across(edge(True, True), edge(False, False), [(i, j) for i in range(3) for j in range(3) if i or j])
    down = across(edge(True, False), edge(False, True), [(i, -j) for i in (1, 2) for j in (1, 2)])
    links = up.unionByName(down).join(heads.withColumnRenamed("__head", "a"), cells)
    links = links.join(heads.select(*keys, F.col("__i").alias("__i0"), F.col("__j").alias("__j0"), F.col("__head").alias("b")), [*keys, "__i0", "__j0"])
    roots = connected_components(links.select("a", "b"))
    told = heads.join(roots, F.col("__head") == F.col("node"), "left").select(*cells, F.coalesce("root", "__head").alias("__root"))
    out = named.withColumns({"__i": cell(x, wide), "__j": cell(y, high)}).join(told, cells, "left")
    return out.withColumn(name, F.coalesce("__root", "__node")).select(*rows.columns, name)
