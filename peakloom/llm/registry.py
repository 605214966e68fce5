"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import exact_dedup, licenses, mixing, packing, quality_classifier, quality_rules, sharding, simhash, substrings, warc
from peakloom.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", exact_dedup.digest("text").alias("text_sha256"))
    marked = exact_dedup.mark_digests(materialize(docs, "digests"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_verdicts(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    passages = substrings.shared_passages(substrings.keyed(docs, "doc_id", "text"))
    return substrings.digest_repeats(substrings.remove_repeats(docs), passages)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_verdicts(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps a public tokenizer's vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_vocabulary())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mix": op3_mix,
    "op4_quality_rules": op4_quality_rules,
    "op5_licenses": op5_licenses,
    "op6_repeats": op6_repeats,
    "op7_shards": op7_shards,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_quality_rules": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
        dup AS (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM dup GROUP BY doc_id),
        m AS (SELECT d.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
        r AS (SELECT * EXCLUDE (ls), CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
        f AS (SELECT *, base_failed OR n_symbols * 10 > word_chars OR n_dup_lines * 20 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 15 AS failed FROM r),
        h AS (SELECT source AS host, count(*) AS n, count(*) FILTER (failed) AS bad, count(*) FILTER (failed) / count(*) AS rate FROM f WHERE source IS NOT NULL GROUP BY source),
        p AS (SELECT avg(rate) AS mean, avg(rate) * (1 - avg(rate)) AS noise, (var_pop(rate) - avg(rate) * (1 - avg(rate)) * avg(1 / n)) / nullif(1 - avg(1 / n), 0) AS excess FROM h),
        q AS (SELECT mean, CASE WHEN noise > 0 AND excess > 0 THEN greatest(least(noise / excess - 1, 1e9), 1.0e0) ELSE 1e9 END AS weight FROM p),
        v AS (SELECT host, (bad + mean * weight) / (n + weight) AS host_rate FROM h CROSS JOIN q)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 6) AS host_rate, NOT base_failed AND coalesce(host_rate <= 0.5e0, true) AS kept
        FROM f LEFT JOIN v ON source = host""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages), s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS x, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
        c AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || x[5 * i + 1:5 * i + 5] AS BIGINT)) AS parts FROM s)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM c""",
}
