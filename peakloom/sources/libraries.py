"""Spectral libraries in MSP and MGF text as tables.

Records are cut by Spark's text source at their separators, so a large file is read by many tasks; a file with
other line ends comes as one record and is cut again while parsing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, precursor_mz double, formula string, adduct string, rt double, metadata map<string,string>, peaks array<struct<mz:double,intensity:double>>"
RECORDS = 10_000  # records handed on at once
_BLANK = re.compile(r"\n\s*\n")
# Headers with a column of their own.
MSP_KEYS = {"PRECURSORMZ": "precursor_mz", "PRECURSOR_MZ": "precursor_mz", "NAME": "name", "FORMULA": "formula", "RETENTIONTIME": "rt", "RT": "rt", "PRECURSOR_TYPE": "adduct", "PRECURSORTYPE": "adduct", "ADDUCT": "adduct"}
MGF_KEYS = {"PEPMASS": "precursor_mz", "NAME": "name", "TITLE": "name", "FORMULA": "formula", "RTINSECONDS": "rt", "RETENTIONTIME": "rt"}


def _float(text: str) -> float | None:
    try:
        return float(text.split()[0])
    except (ValueError, IndexError):
        return None


def _put(record: dict, key: str, value: str, known: dict[str, str]) -> None:
    name = known.get(key.upper())
    if name in ("precursor_mz", "rt"):
        number = _float(value)
        if number is not None:
            record[name] = number
    elif name:
        record[name] = value
    else:
        record["metadata"][key.lower()] = value


def _peaks(record: dict, text: str) -> None:
    """Add the peaks of a line, packed by semicolons or alone."""
    for chunk in text.split(";") if ";" in text else (text,):
        numbers = chunk.split(None, 2)
        if len(numbers) > 1:
            try:
                mz, intensity = float(numbers[0]), float(numbers[1])
            except ValueError:
                continue
            record["mz"].append(mz)
            record["intensity"].append(intensity)


def _msp(text: str) -> Iterator[dict]:
    """Records of MSP text, their peaks as two lists."""
    for block in _BLANK.split(text.replace("\r", "")):
        record: dict = {"metadata": {}, "mz": [], "intensity": []}
        inside = False
        for line in block.split("\n"):
            line = line.strip()
            if not line:
                continue
            if inside:
                _peaks(record, line)
            elif ":" in line:
                key, value = (x.strip() for x in line.split(":", 1))
                inside = key.upper() == "NUM PEAKS"
                if not inside:
                    _put(record, key, value, MSP_KEYS)
        if record["mz"]:
            yield record


def _mgf(text: str) -> Iterator[dict]:
    """Records of MGF text, their peaks as two lists."""
    for block in text.replace("\r", "").split("END IONS"):
        _, begun, body = block.partition("BEGIN IONS")
        record: dict = {"metadata": {}, "mz": [], "intensity": []}
        for line in body.split("\n"):
            line = line.strip()
            if "=" in line:
                _put(record, *(x.strip() for x in line.split("=", 1)), MGF_KEYS)
            elif line:
                _first_peak(record, line)
        if begun and record["mz"]:
            yield record


def _first_peak(record: dict, line: str) -> None:
    before = len(record["mz"])
    for chunk in line.split(";") if ";" in line else (line,):
        _peaks(record, chunk)
        if len(record["mz"]) > before:
            break


def _told(records: Iterator[dict]) -> Iterator[dict]:
    for r in records:
        mz, intensity = r.pop("mz"), r.pop("intensity")
        yield r | {"peaks": [{"mz": m, "intensity": x} for m, x in zip(mz, intensity)]}


def parse_msp(text: str) -> Iterator[dict]:
    """Records of MSP text with at least one peak; headers in any case, peaks one a line or packed by semicolons."""
    return _told(_msp(text))


def parse_mgf(text: str) -> Iterator[dict]:
    """Records of MGF text with at least one peak; retention times stay as written."""
    return _told(_mgf(text))


def _read(spark: SparkSession, path: str | list[str], separator: str, parse) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = spark.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = [r for text in batch.column("value").to_pylist() for r in parse(text)]
            for begin in range(0, len(found), RECORDS):
                some = found[begin : begin + RECORDS]
                ends = pa.array(np.cumsum([0, *(len(r["mz"]) for r in some)]), pa.int32())
                mz, intensity = (pa.array([x for r in some for x in r[c]], pa.float64()) for c in ("mz", "intensity"))
                peaks = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([mz, intensity], ["mz", "intensity"]))
                plain = [pa.array([list(r["metadata"].items()) if f == "metadata" else r.get(f) for r in some], arrow.field(f).type) for f in arrow.names if f != "peaks"]
                yield pa.RecordBatch.from_arrays([*plain, peaks.cast(arrow.field("peaks").type)], names=arrow.names)

    rows = spark.read.option("lineSep", separator).text(path).mapInArrow(run, schema)
    return rows.withColumn("spec_id", F.xxhash64("name", "precursor_mz", "peaks"))


def read_msp(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """spec_id (equal records share it), name, precursor_mz, formula, adduct, rt, metadata and peaks."""
    return _read(spark, path, "\n\n", _msp)


def read_mgf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_msp``."""
    return _read(spark, path, "END IONS", _mgf)


def read_library(spark: SparkSession, path: str) -> DataFrame | None:
    """A library by its suffix; None for any other."""
    reader = {"msp": read_msp, "mgf": read_mgf}.get(path.rpartition(".")[2].lower())
    return reader(spark, path) if reader else None


def lean(library: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns that a search needs, with only the named metadata."""
    names = F.array(*[F.lit(k) for k in keep]) if keep else F.array().cast("array<string>")
    return library.select("spec_id", "name", "precursor_mz", "formula", "adduct", "rt", "peaks", F.map_filter("metadata", lambda k, _: F.array_contains(names, k)).alias("metadata"))
