"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone.

Every source has a target in words and a weight schedule over training time 0 to 1, piecewise linear
between equally spaced knots. A document's place in its source's cumulative demand, divided by the
target, is inverted through the integral of the schedule; that gives its training position. Rows are
range-sorted by position; the ranges hold equal shares of the demand integrated over all sources. All of it is
planned on ids and sizes; texts move only to their places. Cumulative demand is a two-level prefix sum over chunks of a hashed order, so that
a source with a third of all rows is spread over many windows. Chunks are leading bits of the hash: their number
follows the number of rows (``CHUNK_ROWS`` a chunk) and changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.text import word_count
from peakloom.session import materialize, release

WEIGHTS, SHARE, CAP, CHUNK_ROWS = (3, 1, 2), 1.5, 2, 4096
#: Weight schedules, dealt to the sources in turn: falling, level and rising.
SCHEDULES = ((1.5, 1.25, 1.0, 0.75, 0.5), (1.0, 1.0, 1.0, 1.0, 1.0), (0.5, 0.75, 1.0, 1.25, 1.5))
TAKES = "__takes"


def source_key(column: str) -> Column:
    """A key that is never null and tells a null source from any other."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Target words of each source (one row a source: source, source_size).

    The weights repeat over the sources by code point, null last. A target stops at ``cap`` times the
    source's size and the excess is reshared by weight until none is above: with sources sorted by
    size over weight, the capped ones come first, and the first source that the remaining budget
    leaves under its cap fixes the words per weight of it and all later ones.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1).cast("int")
    ranked = sizes.select("source", "source_size", rank.alias("rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = ranked.withColumns({"weight": weight, "limit": (F.col("source_size") * cap).cast("double")})
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, rest, every = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * share
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level)
    free = F.col("level") <= F.col("limit") / F.col("weight")
    ranked = ranked.withColumn("common", F.first(F.when(free, F.col("level")), ignorenulls=True).over(every))
    target = F.least(F.col("limit"), F.coalesce(F.col("common") * F.col("weight"), F.col("limit")))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def integral(time: Column, knots: Sequence[float]) -> Column:
    """The part of a schedule's whole demand that is met by ``time`` (0 to 1)."""
    m, cum = len(knots) - 1, [0.0]
    for a, b in zip(knots, knots[1:]):
        cum.append(cum[-1] + (a + b) / 2)
    out = None
    for j in range(m - 1, -1, -1):
        x = time * m - j
        done = F.lit(cum[j]) + x * knots[j] + x * x * ((knots[j + 1] - knots[j]) / 2)
        out = done if out is None else F.when(time < (j + 1) / m, done).otherwise(out)
    return out / cum[-1]


def invert(share_done: Column, rank: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """Training time at which a source has met ``share_done`` (0 to 1) of its demand."""
    out = None
    for k, knots in enumerate(schedules):
        m, cum = len(knots) - 1, [0.0]
        for a, b in zip(knots, knots[1:]):
            cum.append(cum[-1] + (a + b) / 2)
        goal = share_done * cum[-1]
        time = None
        for j in range(m - 1, -1, -1):  # segment j: weight w + s * x at x from 0 to 1
            w, s, left = knots[j], knots[j + 1] - knots[j], goal - F.lit(cum[j])
            x = F.lit(2.0) * left / (F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + left * (2 * s), F.lit(0.0))) + F.lit(1e-300))
            at = (x + j) / m
            time = at if time is None else F.when(goal < F.lit(cum[j + 1]), at).otherwise(time)
        out = time if out is None else F.when(rank % len(schedules) == k, time).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def plan_mix(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, schedules: Sequence[Sequence[float]] = SCHEDULES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add source_size, target, taken, position, __start and __rank to rows that carry their size, and write them.

    In each source documents stand in a fixed hashed order (hash of id and size, id, size). The source's demand runs
    through that order, and again from its start up to ``cap`` times, until the target is met; ``taken`` is
    the words that it takes of the document, repeats counted: the sum over a source equals the target,
    rounded. Null ids are spread by size. Sources without words have target 0. ``position`` is the training
    time of the first take, null if nothing is taken. Rows equal in id and size are interchangeable.
    """
    bits = max(6, (rows.count() // chunk_rows).bit_length())
    keyed = rows.withColumns({"__source": source_key(source_col), "__hash": F.xxhash64(F.col(id_col), F.col(size_col))})
    keyed = keyed.withColumn("__chunk", F.shiftrightunsigned("__hash", 64 - bits))
    sums = keyed.groupBy("__source", "__chunk").agg(F.sum(size_col).alias("__words"))
    sums = materialize(sums, "mix-chunks")
    named = F.when(F.col("__source") != "n", F.substring("__source", 2, 1 << 30)).alias("source")
    per = targets(sums.groupBy("__source").agg(F.sum("__words").alias("source_size")).select(named, "source_size"), weights, share, cap)
    per = per.withColumn("__source", source_key("source")).drop("source").withColumnRenamed("rank", "__rank")
    before = Window.partitionBy("__source").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__source", "__chunk", F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__base")).join(per, "__source")
    unsigned = F.shiftrightunsigned("__hash", 1)  # the low bit only parts rows that the id then orders
    inside = Window.partitionBy("__source", "__chunk").orderBy(unsigned, id_col, size_col).rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.withColumn("__start", F.sum(size_col).over(inside) - F.col(size_col)).join(bases, ["__source", "__chunk"])
    joined = joined.withColumn("__start", F.col("__base") + F.col("__start"))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    part = lambda k: F.greatest(F.lit(0), F.least(F.col(size_col), goal - F.col("source_size") * k - F.col("__start")))
    taken = sum((part(k) for k in range(1, cap)), part(0)).cast("long")
    out = joined.withColumns({"taken": taken, "target": F.round("target", 6)})
    out = out.withColumn("position", F.when(F.col("taken") > 0, take_time(0, schedules)))
    plan = materialize(out.drop("__source", "__hash", "__chunk", "__base"), "mix-plan")
    release(sums)
    return plan


def take_time(take: Column | int, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """Training time of a document's take, counted from 0: where its source's demand comes past it again."""
    done = F.col("__start") + F.col("source_size") * take
    return invert(F.when(F.col("target") > 0, done / F.col("target")), F.col("__rank"), schedules)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and position of every row, sorted by position.

    Sizes are word counts; a null text has none. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    sizes = materialize(rows, "mix-sizes")
    plan = plan_mix(sizes, **options)
    release(sizes)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: Sequence[Sequence[float]] = SCHEDULES, **options) -> DataFrame:
    """The documents in training order, whole and as often as the mix takes them.

    The copies of a document are ``taken`` over its size, rounded half up, so that texts are not cut; a
    source differs from its target by half a document at most. Copies stand at the positions of their
    pass. The columns are those of ``docs``; its own columns of clashing names are kept. Rows equal in all columns are
    planned as one document of all their words and come as often as that takes it, so no task holds them. Null ids and
    texts are values like others, documents without words are not taken, and an empty table gives an empty one.

    Two 64-bit hashes of all columns name a document, so the plan moves no text. Texts move once to their plan and once to the
    range of positions they belong to; ranges have equal shares of all demand, known from the schedules, so nothing is sampled.
    """
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    cells = list(own.values())
    renamed = docs.select(*[F.col(c).alias(own[c]) for c in docs.columns])
    hashed = [F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in renamed.dtypes]
    nulls = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cells])  # a hash passes over nulls
    keyed = renamed.withColumns({"k1": F.xxhash64(*hashed, nulls), "k2": F.xxhash64(nulls, F.lit(1), *reversed(hashed))})
    sizes = keyed.select("k1", "k2", F.col(own[id_col]).alias("id"), F.col(own[source_col]).alias("source"), word_count(own[text_col]).alias("one"))
    sizes = sizes.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("source").alias("source"), F.first("one").alias("one"), (F.first("one") * F.count("*")).alias("size"))
    sizes = materialize(sizes, "mix-sizes")
    plan = plan_mix(sizes, "id", "source", "size", schedules=schedules, **options)
    release(sizes)
    copies = F.floor(F.col("taken") / F.greatest("one", F.lit(1)) + 0.5).cast("int")
    rows = F.greatest(F.col("size") / F.greatest("one", F.lit(1)), F.lit(1.0))  # equal rows that are one document here
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    demand = [F.sum(F.when(F.col("__rank") % len(schedules) == k, F.col("taken"))) for k in range(len(schedules))]
    total = [float(x or 0) for x in plan.agg(*demand).first()]
    takes = plan.withColumns({TAKES: copies, "__rows": rows}).where(F.col(TAKES) > 0)
    takes = takes.select("k1", "k2", TAKES, "__rows", "__start", "source_size", "target", "__rank", F.col("id").alias("__id"))
    texts = keyed.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in cells])
    placed = texts.join(takes.hint("shuffle_hash"), ["k1", "k2"]).withColumn("__take", F.explode(F.sequence(F.lit(0), F.col(TAKES) - 1)))
    placed = placed.withColumn("__at", take_time(F.floor(F.col("__take") / F.col("__rows")), schedules))
    done = sum((integral(F.col("__at"), knots) * w for w, knots in zip(total, schedules)), F.lit(0.0)) / max(sum(total), 1.0)
    placed = placed.withColumn("__range", F.least(F.greatest(F.floor(done * parts), F.lit(0)), F.lit(parts - 1)).cast("int"))
    placed = placed.select(*cells, "__at", "__id", "__take", "__range")
    placed = placed.repartitionById(parts, F.col("__range")).sortWithinPartitions("__at", "__id", "__take")
    return placed.select(*[F.col(v).alias(k) for k, v in own.items()])
