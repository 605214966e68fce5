"""Column expressions and Arrow helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: str | Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the faster ``lower``; others are translated."""
    t = whole(text)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def word_count(text: str | Column) -> Column:
    """Number of words, a word being a run without space and U+0009 to U+000D."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def slim(batches: Iterable[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Split batches so that ``column`` holds about ``most`` bytes in each; long texts stay whole."""
    for batch in batches:
        begin, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            if held + (n or 0) > most and i > begin:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def map_rows(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, text: str = "text", most: int = 16 << 20) -> DataFrame:
    """Run ``kernel`` on Arrow batches of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches, text, most):
            yield kernel(batch)

    return df.mapInArrow(run, schema)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Hand Arrow batches of ``rows`` rows and about ``size`` bytes at most to Python, where the session allows more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < have <= size:
        spark.conf.set(key, f"{size}b")
