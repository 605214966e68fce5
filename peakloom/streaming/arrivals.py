"""Segment files as they arrive: a stream of new mzML files, parsed and appended to a table of scans."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from peakloom.sources.mzml import scans_of

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Parse what has arrived since the last run, each file once, and append it to the Parquet table; ends when all is read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.mz[Mm][Ll]").option("maxFilesPerTrigger", files_per_batch).load(folder)
    scans = scans_of(files, skip_damaged=True)
    return scans.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start()
