"""mzML files as a table of scans.

Files come through Spark's ``binaryFile`` source, so any store that Spark reads will do; one file is parsed by one
task, scan by scan.
"""

from __future__ import annotations

import base64
import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, ordinal long, ms_level int, rt double, mz array<double>, intensity array<double>, precursor_mz double, precursor_intensity double, "
    "target double, iso_lo double, iso_hi double, collision_energy double"
)
# Terms of the controlled vocabulary.
LEVEL, START, ION, ION_HEIGHT, TARGET, LOWER, UPPER, ENERGY = "MS:1000511", "MS:1000016", "MS:1000744", "MS:1000042", "MS:1000827", "MS:1000828", "MS:1000829", "MS:1000045"
MZ_ARRAY, HEIGHT_ARRAY, ZLIB, SINGLE, SECONDS = "MS:1000514", "MS:1000515", "MS:1000574", "MS:1000521", "UO:0000010"


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _terms(element: ElementTree.Element, unit: bool = False) -> dict[str, str]:
    return {c.get("accession", ""): (c.get("unitAccession", "") if unit else c.get("value", "")) for c in element.iter() if _tag(c) == "cvParam"}


def _number(terms: dict[str, str], key: str) -> float | None:
    try:
        return float(terms[key])
    except (KeyError, ValueError):
        return None


def _array(element: ElementTree.Element) -> tuple[str | None, np.ndarray]:
    terms = _terms(element)
    text = next((c.text or "" for c in element.iter() if _tag(c) == "binary"), "")
    data = base64.b64decode(text)
    data = zlib.decompress(data) if ZLIB in terms and data else data
    kind = next((k for k in (MZ_ARRAY, HEIGHT_ARRAY) if k in terms), None)
    return kind, np.frombuffer(data, "<f4" if SINGLE in terms else "<f8").astype(float)


def parse_scans(content: bytes, ms_level: int | None = None) -> Iterator[dict]:
    """Each spectrum of a file with its ordinal; arrays are empty where absent, RT is in minutes."""
    ordinal = -1
    for _, element in ElementTree.iterparse(io.BytesIO(content)):
        if _tag(element) != "spectrum":
            continue
        ordinal += 1
        terms, units = _terms(element), _terms(element, True)
        level = _number(terms, LEVEL)
        if level is not None and (ms_level is None or int(level) == ms_level):
            arrays = dict(_array(x) for x in element.iter() if _tag(x) == "binaryDataArray")
            start, target = _number(terms, START), _number(terms, TARGET)
            if start is not None and units.get(START) == SECONDS:
                start /= 60
            low, high = _number(terms, LOWER), _number(terms, UPPER)
            yield {
                "ordinal": ordinal, "ms_level": int(level), "rt": start, "mz": arrays.get(MZ_ARRAY, np.zeros(0)), "intensity": arrays.get(HEIGHT_ARRAY, np.zeros(0)),
                "precursor_mz": _number(terms, ION) if _number(terms, ION) is not None else target, "precursor_intensity": _number(terms, ION_HEIGHT), "target": target,
                "iso_lo": None if target is None or low is None else target - low, "iso_hi": None if target is None or high is None else target + high, "collision_energy": _number(terms, ENERGY),
            }
        element.clear()


def scans_of(files: DataFrame, ms_level: int | None = None, skip_damaged: bool = False) -> DataFrame:
    """Parse rows of ``binaryFile`` (path, content), batch or streaming; a damaged file raises, or is left out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = files.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows: list[dict] = []
                try:
                    for scan in parse_scans(content.as_py(), ms_level):
                        rows.append(scan | {"path": path, "mz": scan["mz"].tolist(), "intensity": scan["intensity"].tolist()})
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                except (ElementTree.ParseError, zlib.error, ValueError):
                    if not skip_damaged:
                        raise
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read_mzml(spark: SparkSession, paths: str | list[str], ms_level: int | None = None, skip_damaged: bool = False) -> DataFrame:
    """The scans of mzML files or folders: path, ordinal, ms_level, rt, mz, intensity, precursor and isolation window."""
    return scans_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.mz[Mm][Ll]").load(paths), ms_level, skip_damaged)


# Naming conventions of segment files, most specific first.
NAMES = (r"^(.+?)_(\d+)-(\d+)_\d+_(\d+)_(\d+)$", r"^(.+?)_(\d+)-(\d+)_(\d+)$", r"^(.+?)_(\d+)-(\d+)$")
LOOSE = r"^(.*?)(\d+)-(\d+)(.*)$"


def file_parts(path: Column) -> Column:
    """Struct of sample, seg_low, seg_high, step and rep from a file name; null where it holds no range."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    part = lambda k, i: F.regexp_extract(stem, NAMES[k], i)
    whole = lambda c: F.try_to_number(F.nullif(c, F.lit("")), F.lit("9" * 18)).cast("int")
    form = lambda sample, low, high, step, rep: F.struct(sample.alias("sample"), low.cast("int").alias("seg_low"), high.cast("int").alias("seg_high"), step.cast("int").alias("step"), rep.cast("int").alias("rep"))
    zero, one = F.lit(0), F.lit(1)
    prefix = F.rtrim(F.regexp_replace(F.regexp_extract(stem, LOOSE, 1), r"[_\- ]+$", ""))
    loose = form(F.coalesce(F.nullif(prefix, F.lit("")), F.lit("Sample")), whole(F.regexp_extract(stem, LOOSE, 2)), whole(F.regexp_extract(stem, LOOSE, 3)), zero, F.coalesce(whole(F.regexp_extract(F.regexp_extract(stem, LOOSE, 4), r"(\d+)", 1)), one))
    return (
        F.when(stem.rlike(NAMES[0]), form(part(0, 1), whole(part(0, 2)), whole(part(0, 3)), whole(part(0, 4)), whole(part(0, 5))))
        .when(stem.rlike(NAMES[1]), form(part(1, 1), whole(part(1, 2)), whole(part(1, 3)), zero, whole(part(1, 4))))
        .when(stem.rlike(NAMES[2]), form(part(2, 1), whole(part(2, 2)), whole(part(2, 3)), zero, one))
        .when(stem.rlike(LOOSE), loose)
    )


def group_files(files: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(path, sample): by replicate number, or by ``groups`` (path or file name, sample); what those leave out stands alone.

    Without groups a name that holds no range raises.
    """
    name = F.element_at(F.split("path", "/"), -1)
    if groups is None:
        rep = file_parts(F.col("path"))["rep"]
        return files.select("path", F.coalesce(rep.cast("string"), F.raise_error(F.concat(F.lit("no segment range in the file name: "), name)).cast("string")).alias("sample"))
    known = groups.select(F.element_at(F.split("path", "/"), -1).alias("__name"), F.col("sample"))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.withColumn("__name", name).join(known, "__name", "left").select("path", F.coalesce("sample", F.concat(F.lit("ungrouped_"), stem)).alias("sample"))


def load_cycles(scans: DataFrame) -> DataFrame:
    """Cycles of segment files: path, cycle, rt, ms_level, window, target, mz, intensity, one row per spectrum that counts.

    A cycle is one survey scan and a scan for each nominal window of the file's range. Of several surveys in a cycle
    the one with most points stands (the first on ties); product scans are keyed by the floor of their target, the
    last of a key standing.
    """
    from pyspark.sql import Window

    parts = file_parts(F.col("path"))
    rows = scans.withColumn("per_cycle", parts["seg_high"] - parts["seg_low"] + 2)
    rows = rows.withColumns({"cycle": F.floor(F.col("ordinal") / F.col("per_cycle")), "window": F.when(F.col("ms_level") == 2, F.floor("target"))})
    start = F.min_by("rt", "ordinal").over(Window.partitionBy("path", "cycle"))
    rows = rows.withColumn("rt", start).where("ms_level = 1 OR (ms_level = 2 AND window IS NOT NULL)")
    best = Window.partitionBy("path", "cycle", "ms_level", "window").orderBy(F.when(F.col("ms_level") == 1, -F.size("mz")).otherwise(-F.col("ordinal")), "ordinal")
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("path", "cycle", "rt", "ms_level", "window", "target", "mz", "intensity")


def long_points(cycles: DataFrame) -> DataFrame:
    """One row per centroid: path, cycle, rt, ms_level, window, mz, intensity."""
    point = F.explode(F.arrays_zip("mz", "intensity")).alias("p")
    return cycles.select("path", "cycle", "rt", "ms_level", "window", point).select("path", "cycle", "rt", "ms_level", "window", "p.mz", "p.intensity")
