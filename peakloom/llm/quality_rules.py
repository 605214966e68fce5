"""Quality rules with host-level verdicts.

Every document is measured and judged by rules. Failures are summed per host; a host's failure rate is
shrunk with a beta prior fitted to all hosts (method of moments), so that small hosts lean towards the
common rate; the verdict of its host is joined back to each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.text import bounded_batches, map_rows, whole
from peakloom.session import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACES, SYMBOLS, WINDOW = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"), tuple(bytes([c]) for c in b"#*$%&|<>"), 8
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight in rows.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e9


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more.

    Windows are compared by a 64-bit hash first; those that seem repeated are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29)))
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(mixed, twice)).tolist()
    found: dict[tuple, list[int]] = {}
    for i in starts:
        found.setdefault(tuple(words[i : i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for at in found.values():
        if len(at) > 1:
            np.add.at(edge, at, 1)
            np.add.at(edge, np.asarray(at) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure_text(data: bytes) -> tuple[int, int, int, int, int]:
    """The measures of one text in UTF-8."""
    words = data.split()  # bytes split at space and U+0009 to U+000D alone
    lines = [x for x in data.split(b"\n") if x.strip()]
    points = len(data.decode("utf-8", "replace")) - sum(map(data.count, SPACES))
    return len(words), points, sum(map(data.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [measure_text(x) for x in batch.column("__text").to_pylist()]
    columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(len(MEASURES))]
    kept = [n for n in batch.schema.names if n != "__text"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns], names=[*kept, *MEASURES])


def measure(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures to ``rows``, whose own columns must not bear their names."""
    bounded_batches(rows.sparkSession)
    schema = rows.schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    return map_rows(rows.withColumn("__text", whole(text_col).cast("binary")), _kernel, schema, "__text")


def base_failed() -> Column:
    """Under 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def rule_failed() -> Column:
    """Any rule: the base rules, over 10 % symbols, a repeated line for each 20 words, or words of under 2 or over 15 characters in the mean."""
    chars, words = F.col("word_chars"), F.col("n_words")
    return base_failed() | (F.col("n_symbols") * 10 > chars) | (F.col("n_dup_lines") * 20 > words) | (chars < words * 2) | (chars > words * 15)


def host_verdicts(measured: DataFrame, host_col: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: __host, host_rows, host_failures, host_rate (shrunk) and host_ok.

    Rows without a host form no host. The prior is the beta distribution that has the mean and the spread of the hosts' rates, each
    host counting once, after the spread that chance alone gives them is taken off. Its weight is in rows: where the hosts
    agree as far as chance allows it is ``MOST_WEIGHT``, and the common rate stands for each; where they differ more than any beta
    distribution can, as when each is all good or all bad, it is ``LEAST_WEIGHT``, and each has its own rate.
    """
    hosts = measured.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("__host"))
    hosts = hosts.agg(F.count("*").alias("host_rows"), F.count_if(rule_failed()).alias("host_failures"))
    hosts = materialize(hosts, "hosts").withColumn("rate", F.col("host_failures") / F.col("host_rows"))
    total = hosts.agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("spread"), F.avg(F.lit(1.0) / F.col("host_rows")).alias("inverse"))
    noise = F.col("mean") * (1 - F.col("mean"))
    # The variance of rates beyond that of counts; null where every host has one row.
    excess = F.try_divide(F.col("spread") - noise * F.col("inverse"), 1 - F.col("inverse"))
    weight = F.when((noise > 0) & (excess > 0), F.greatest(F.least(noise / excess - 1, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT))).otherwise(F.lit(MOST_WEIGHT))
    prior = materialize(total.select("mean", weight.alias("weight")), "host-prior")
    mean, weight = prior.select("mean").scalar(), prior.select("weight").scalar()
    rate = (F.col("host_failures") + mean * weight) / (F.col("host_rows") + weight)
    return hosts.withColumn("host_rate", rate).withColumn("host_ok", F.col("host_rate") <= max_rate).drop("rate")


def judge(measured: DataFrame, host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Add base_failed, host_rate and kept to measured rows.

    A row is kept unless a base rule fails or its host is rejected. A null host is never rejected. A null
    or empty text has no words and fails. Repeated rows each count and each get the verdict.
    """
    hosts = host_verdicts(measured, host_col, max_rate).select("__host", "host_rate", "host_ok")
    out = measured.withColumn("base_failed", base_failed()).join(hosts, F.col(host_col) == F.col("__host"), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("host_ok")


def rule_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, the measures, base_failed, host_rate and kept of each row; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    narrow = rows.select("doc_id", "host", whole("text").cast("binary").alias("__text"))
    bounded_batches(docs.sparkSession)
    schema = rows.select("doc_id", "host").schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    measured = materialize(map_rows(narrow, _kernel, schema, "__text"), "measures")
    return judge(measured, "host", max_rate).drop("host")


def passing_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns (whatever their names).

    Texts are measured once: rows are written with their measures, and read again with the hosts' verdicts. Null and
    empty texts fail, null hosts are not rejected, repeated rows are judged alike and an empty table gives an empty one.
    """
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(own[c]) for c in docs.columns])
    host, text = own[host_col], own[text_col]
    judged = materialize(measure(renamed, text), "measured")
    hosts = host_verdicts(judged, host, max_rate).where("NOT host_ok").select("__host")
    kept = judged.where(~base_failed()).join(hosts, F.col(host) == F.col("__host"), "left_anti")
    return kept.select(*[F.col(v).alias(k) for k, v in own.items()])
