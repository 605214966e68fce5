"""Projects and notes: tables beside a manifest that says which version of the format they have."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

VERSION = 1


def _version(spark: SparkSession, folder: str) -> int | None:
    """The version that a folder's manifest tells; None where there is no manifest."""
    try:
        rows = spark.read.schema("version int, part string").json(f"{folder}/manifest").collect()  # one a part
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[0]["version"] if rows else None


def save_project(parts: Mapping[str, DataFrame], folder: str, version: int = VERSION) -> None:
    """Write each part as Parquet and the manifest last, so that a folder with a manifest is whole."""
    spark = next(iter(parts.values())).sparkSession
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    manifest = spark.createDataFrame([(version, name) for name in sorted(parts)], "version int, part string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def load_project(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parts of a project; warns where it is of another version, and raises where the folder holds none."""
    found = _version(spark, folder)
    if found is None:
        raise FileNotFoundError(f"{folder} holds no project")
    if found != VERSION:
        warnings.warn(f"{folder} is of version {found}, not {VERSION}", stacklevel=2)
    names = [r["part"] for r in spark.read.schema("version int, part string").json(f"{folder}/manifest").collect()]
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def load_notes(spark: SparkSession, folder: str) -> DataFrame | None:
    """The notes stored in a folder; None where there are none or they are of another version."""
    return spark.read.parquet(f"{folder}/notes") if _version(spark, folder) == VERSION else None
