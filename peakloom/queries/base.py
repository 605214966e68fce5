"""Registration of queries and the shapes that the shared tables lend to them.

Spectra, points, features and chromatograms are read off the star schema: lineitem rows are centroids,
orders are features of five samples, events are chromatograms of five channels, embeddings are library
spectra on a grid. Each shape exists as a DataFrame here and as a common table expression for the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHAPES = {
    "points": "SELECT l_returnflag AS run, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT) AS scan, l_extendedprice / 100 AS mz, l_quantity AS intensity FROM lineitem",
    "spectra": "SELECT l_orderkey AS spec_id, l_extendedprice / 100 AS mz, l_quantity AS intensity FROM lineitem",
    "axis": "SELECT CAST(unnest(generate_series(0, 719)) AS INT) AS scan",
    "raw": "SELECT event_type AS channel, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS INT) AS scan, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "chrom": "SELECT c.channel, a.scan, CAST(coalesce(r.cents, 0) AS DOUBLE) AS intensity FROM (SELECT DISTINCT channel FROM raw) c CROSS JOIN axis a LEFT JOIN raw r ON r.channel = c.channel AND r.scan = a.scan",
    "features": "SELECT o_orderkey AS id, o_orderpriority AS sample, o_totalprice / 1000 AS mz, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 100 AS rt, o_totalprice AS height, o_orderstatus AS route, o_custkey AS spot FROM orders",
    "library": "SELECT vec_id AS spec_id, label AS bucket, 50.0e0 + 10 * (k - 1) AS mz, CAST(round(abs(CAST(embedding[k] AS DOUBLE)) * 1000) AS DOUBLE) AS intensity FROM (SELECT vec_id, label, embedding, unnest(generate_series(1, 64)) AS k FROM embeddings)",
}
NEEDS = {"chrom": ("axis", "raw")}


def query(name: str, sql: str | None = None, shapes: str = ""):
    """Register a query; ``sql`` may read the named shapes."""

    def take(f):
        QUERIES[name] = f
        if sql is not None:
            wanted: list[str] = []
            for s in shapes.split():
                wanted += [x for x in (*NEEDS.get(s, ()), s) if x not in wanted]
            head = ", ".join(f"{s} AS ({SHAPES[s]})" for s in wanted)
            SQL[name] = (f"WITH {head}" + (", " + sql.strip()[5:] if sql.strip().upper().startswith("WITH ") else " " + sql)) if head else sql
        return f

    return take


def days(column: str):
    return F.datediff(F.to_date(column), F.lit("1995-01-01").cast("date"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids: run, scan, mz, intensity."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_returnflag").alias("run"), days("l_shipdate").alias("scan"), (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").alias("intensity"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra in long form: spec_id, mz, intensity."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("spec_id"), (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").alias("intensity"))


def raw_chromatograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse chromatograms: channel, scan, intensity (cents)."""
    t = table(spark, sf_dir, "events")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    scan = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(start)) / 3600).cast("int")
    cents = F.round(F.col("value") * 100).cast("long")
    return t.groupBy(F.col("event_type").alias("channel"), scan.alias("scan")).agg(F.sum(cents).cast("double").alias("intensity"))


def chromatograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense chromatograms: channel, scan, intensity."""
    from peakloom.operators.extraction import densify

    return densify(raw_chromatograms(spark, sf_dir), ["channel"], 720)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features: id, sample, mz, rt, height, route, spot."""
    t = table(spark, sf_dir, "orders")
    return t.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("sample"), (F.col("o_totalprice") / 1000).alias("mz"), (days("o_orderdate") / 100).alias("rt"),
        F.col("o_totalprice").alias("height"), F.col("o_orderstatus").alias("route"), F.col("o_custkey").alias("spot"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library peaks in long form: spec_id, bucket, mz, intensity."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x"))
    return t.select(F.col("vec_id").alias("spec_id"), F.col("label").alias("bucket"), (F.lit(50.0) + F.col("k") * 10).alias("mz"), F.round(F.abs(F.col("x").cast("double")) * 1000).alias("intensity"))


def scaled(column, places: int = 6):
    """A double rounded for exact comparison."""
    return F.round(column, places)
