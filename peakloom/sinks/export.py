"""Export of features: a matrix with a column per sample, spectra as MGF and MSP, a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.operators.spectra import mgf_record, msp_record


def feature_matrix(features: DataFrame, cells: DataFrame) -> DataFrame:
    """One row a feature with height, area and status of each sample of ``cells`` (feature_id, sample, height, area, status).

    A sample without a cell gets 0.0 and an empty status. m/z has five decimals, RT three, heights and areas one.
    """
    samples = [r[0] for r in cells.select("sample").distinct().orderBy("sample").collect()]  # one a sample
    columns = []
    for s in samples:
        mine = lambda c, s=s: F.max(F.when(F.col("sample") == s, F.col(c)))
        columns += [F.round(F.coalesce(mine("height"), F.lit(0.0)), 1).alias(f"height_rep{s}"), F.round(F.coalesce(mine("area"), F.lit(0.0)), 1).alias(f"area_rep{s}"), F.coalesce(mine("status"), F.lit("")).alias(f"gap_fill_status_rep{s}")]
    head = [F.round(c, n).alias(c) for c, n in (("mz", 5), ("rt", 3)) if c in features.columns]
    rest = [c for c in features.columns if c not in ("feature_id", "mz", "rt")]
    return features.select("feature_id", *head, *rest).join(cells.groupBy("feature_id").agg(*columns), "feature_id", "left")


def write_table(matrix: DataFrame, path: str) -> None:
    """CSV parts with a header each, ordered by feature."""
    matrix.orderBy("feature_id").write.mode("overwrite").option("header", True).csv(path)


def write_spectra(features: DataFrame, path: str, form: str) -> None:
    """Features with fragments as ``mgf`` or ``msp`` text."""
    some = features.where(F.size("peaks") > 0)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("feature_id")) if "name" in features.columns else F.col("feature_id")
    record = {"mgf": mgf_record, "msp": msp_record}[form](name, F.col("mz"), F.col("rt"), F.col("peaks"))
    some.select(record.alias("value")).write.mode("overwrite").text(path)


def report(counts: dict[str, DataFrame]) -> DataFrame:
    """(stage, metric, value) of one-row tables of counts by stage."""
    out = None
    for stage, df in sorted(counts.items()):
        one = df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("double") for c in df.columns]))).alias("metric", "value")).withColumn("stage", F.lit(stage))
        out = one if out is None else out.unionByName(one)
    return out.select("stage", "metric", "value")
