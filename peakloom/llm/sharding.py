"""Sharding by fixed virtual slots, in DataFrame operations alone.

Records hash into thousands of slots. Bytes are summed per slot, and a versioned map deals slots to
shards: heaviest slot first to the lightest shard. Rebalancing edits a map: slots beyond a shard's fair
load are taken off and dealt again, all others stay where they are. The map has ``slots`` rows whatever
the input, so it may be broadcast; a record's place in its shard is its rank in its slot plus the sizes
of the shard's slots before it, so no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.llm.text import whole
from peakloom.session import materialize, scratch

SLOTS = 8192


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Id, size (UTF-8 bytes and 8), CRC-32 and virtual slot of each row; a null text has no bytes."""
    text = whole(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot in use."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_size"), F.count("*").alias("slot_rows"))


def _deal(loads: Column, loose: Column) -> Column:
    """Fold ``loose`` slots, heaviest first, into the lightest shards of ``loads``."""

    def step(state: Column, slot: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == at, x + slot["slot_size"]).otherwise(x)).alias("loads"),
            F.concat(state["dealt"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), at.alias("shard")))).alias("dealt"),
        )

    none = F.array().cast("array<struct<virtual_slot:int,shard:int>>")
    return F.aggregate(loose, F.struct(loads.alias("loads"), none.alias("dealt")), step)["dealt"]


def rebalance(sizes: DataFrame, shards: int, current: DataFrame | None = None, version: int = 0) -> DataFrame:
    """The next version of the slot map: virtual_slot, shard, version.

    ``current`` is the map in force (none: all slots are loose). Slots of a shard, lightest first, stay up
    to the mean load; slots that a map lacks, that belong to removed shards, or that go beyond the mean
    are dealt again. All of it is on at most one row per slot.
    """
    known = sizes.withColumn("shard", F.lit(None).cast("int"))
    if current is not None:
        known = sizes.join(current.select("virtual_slot", "shard"), "virtual_slot", "left")
        known = known.withColumn("shard", F.when(F.col("shard") < shards, F.col("shard")))
    every = Window.partitionBy()
    running = F.sum("slot_size").over(Window.partitionBy("shard").orderBy("slot_size", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumns({"__mean": F.sum("slot_size").over(every) / shards, "__run": running})
    stays = F.col("shard").isNotNull() & (F.col("__run") <= F.col("__mean"))
    known = known.withColumn("shard", F.when(stays, F.col("shard")))
    held = known.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("slot_size").alias("load"))
    loads = held.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("held"))
    loose = known.where("shard IS NULL").agg(F.sort_array(F.collect_list(F.struct((-F.col("slot_size")).alias("key"), "virtual_slot", "slot_size"))).alias("loose"))
    both = loose.withColumn("held", loads.scalar())
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long")))
    dealt = both.select(F.explode(_deal(start, F.col("loose"))).alias("x")).select("x.virtual_slot", "x.shard")
    return known.where("shard IS NOT NULL").select("virtual_slot", "shard").unionByName(dealt).withColumn("version", F.lit(version))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to a stored map; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of a stored map (the last by default); None where nothing is stored."""
    try:
        stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = stored.agg(F.max("version")).first()[0] if version is None else version
    if last is None or not stored.where(F.col("version") == last).limit(1).count():
        return None
    return stored.where(F.col("version") == last)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless place of each record under a map.

    Rows of a slot are placed by id, CRC and size; rows equal in all three are the same record repeated.
    """
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(F.broadcast(bases), "virtual_slot").withColumn("slot", F.col("base") + rank - 1).drop("base")


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes (law ``bytes``).

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 within the shard), grown_shard
    (null: this law moves rows between old shards too), virtual_slot and map_version. Null texts have size
    8, null ids hash like any value together with the text's CRC, repeated rows get a place each. An empty
    table gives no rows. Other columns of ``docs`` are not read. The map is stored under ``map_path`` (by default in the shared
    folder) and records are placed by what is read back. Where a map is stored there already, it is edited to the
    sizes of these records, and stored as its next version.
    """
    path = map_path or scratch(docs.sparkSession, "slot-map")
    rows = materialize(records(docs, id_col, text_col, slots), "shard-records")
    current = load_map(docs.sparkSession, path)
    version = 0 if current is None else current.agg(F.max("version")).first()[0] + 1
    made = materialize(rebalance(slot_bytes(rows), shards, current, version), "slot-map")
    save_map(made, path)
    stored = load_map(docs.sparkSession, path, version)
    placed = place(rows, made if stored is None else stored)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )
