"""Stage results per sample with a fingerprint, so that a rerun reads what is still valid."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(config: dict, inputs: DataFrame, late: frozenset[str] = frozenset()) -> DataFrame:
    """(sample, fingerprint): SHA-256 of the config without its ``late`` keys (read only after the checkpoint) and of the sample's files.

    ``inputs`` has sample, path, length and modificationTime, as Spark's file source lists them.
    """
    early = json.dumps({k: v for k, v in sorted(config.items()) if k not in late}, sort_keys=True, default=repr)
    stamp = F.concat_ws("|", F.element_at(F.split("path", "/"), -1), F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    files = F.array_join(F.array_sort(F.collect_list(stamp)), ",")
    return inputs.groupBy("sample").agg(F.sha2(F.concat(F.lit(hashlib.sha256(early.encode()).hexdigest()), files).cast("binary"), 256).alias("fingerprint"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, stage, fingerprint, rows) of complete checkpoints; empty where there is none yet."""
    try:
        return spark.read.parquet(f"{folder}/_manifest")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "sample string, stage string, fingerprint string, rows long")


def pending(prints: DataFrame, done: DataFrame, stage: str) -> DataFrame:
    """The samples whose checkpoint is missing or stale."""
    return prints.join(done.where(F.col("stage") == stage), ["sample", "fingerprint"], "left_anti")


def save(rows: DataFrame, prints: DataFrame, folder: str, stage: str) -> None:
    """Write each sample's rows (a folder a sample, replaced whole) and then its manifest entry."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(f"{folder}/{stage}")
    counts = rows.sparkSession.read.parquet(f"{folder}/{stage}").groupBy("sample").agg(F.count("*").alias("rows"))
    entries = prints.join(counts, "sample", "left").select(F.col("sample").cast("string"), F.lit(stage).alias("stage"), "fingerprint", F.coalesce("rows", F.lit(0)).alias("rows"))
    entries.write.mode("append").parquet(f"{folder}/_manifest")


def load(spark: SparkSession, folder: str, stage: str, sample: str | None = None) -> DataFrame:
    """A stage's rows, of one sample if named; Spark reads that sample's folder alone."""
    rows = spark.read.parquet(f"{folder}/{stage}")
    return rows if sample is None else rows.where(F.col("sample") == sample)


def save_chromatograms(traces: DataFrame, path: str) -> None:
    """Store traces (spot_id first) by ranges of spots; reading one spot then touches few files."""
    traces.repartitionByRange("spot_id").sortWithinPartitions("spot_id").write.mode("overwrite").parquet(path)


def load_chromatograms(spark: SparkSession, path: str, spot_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("spot_id") == spot_id)
