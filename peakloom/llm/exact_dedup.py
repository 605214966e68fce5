"""Exact deduplication with a two-pass Bloom filter, in DataFrame operations alone.

Pass 1 builds a blocked Bloom filter: a digest picks one 64-bit word and two bits in it. ``bit_or``,
``bit_xor`` and ``count`` of the masks of a word tell which bits were set more than once; these are
kept. Pass 2 probes it: a row whose two bits were both set more than once is possibly repeated, and
only such rows shuffle. All other rows pass straight through. The filter has ``max_words`` words at
most (16 bytes each), which bounds the broadcast; when it fills up more rows shuffle, and the result
stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.text import ascii_lower, whole
from peakloom.session import materialize, release

MAX_WORDS, FILTER_WORDS = 1 << 20, 1 << 18
WORD, MASK, DIGEST, KEEP, SIZE, LIVE = "__bloom_word", "__bloom_mask", "__digest", "__keep", "__size", "__live"
OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def digest(text: str = "text") -> Column:
    """SHA-256 of the text in UTF-8, A-Z lower-cased, null as empty."""
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def bloom_cell(key: Column, words: int) -> tuple[Column, Column]:
    """The filter word of a digest and its mask of two different bits."""
    h = F.xxhash64(key)
    first = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(63))
    second = (first + 1 + F.pmod(F.shiftrightunsigned(h, 38), F.lit(63))) % 64
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))
    return F.pmod(h, F.lit(words)), bit(first).bitwiseOR(bit(second))


def repeated_bits(cells: DataFrame) -> DataFrame:
    """Pass 1: for each filter word the bits that two or more rows set.

    Where extra settings equal the bits set an even number of times, each of those was set twice and
    the others once. Otherwise the whole word counts as repeated, which only costs a shuffle.
    """
    seen = cells.groupBy(WORD).agg(F.bit_or(MASK).alias("seen"), F.bit_xor(MASK).alias("odd"), (F.count("*") * 2).alias("n"))
    even = F.col("seen").bitwiseAND(F.bitwise_not("odd"))
    extra = F.col("n") - F.bit_count("seen")
    bits = F.when(extra == 0, F.lit(0).cast("long")).when(extra == F.bit_count(even), even).otherwise(F.col("seen"))
    return seen.select(WORD, bits.alias("__bits")).where("__bits != 0")


def possibly(rows: DataFrame, some: DataFrame, row_key: str, some_key: str, words: int = FILTER_WORDS) -> DataFrame:
    """Add ``maybe``: whether ``row_key`` of a row may be among ``some_key`` of ``some``, by a Bloom filter of ``words`` words at most.

    The filter is broadcast: 16 bytes a word. Beyond its capacity more rows are maybes, and the result of what follows stays the same.
    """
    word, mask = bloom_cell(F.col(some_key), words)
    bits = some.select(word.alias(WORD), mask.alias(MASK)).groupBy(WORD).agg(F.bit_or(MASK).alias("__bits"))
    word, mask = bloom_cell(F.col(row_key), words)
    probed = rows.withColumns({WORD: word, MASK: mask}).join(F.broadcast(bits), WORD, "left")
    return probed.withColumn("maybe", F.coalesce(F.col("__bits").bitwiseAND(F.col(MASK)) == F.col(MASK), F.lit(False))).drop(WORD, MASK, "__bits")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """Add ``text_sha256``, ``keep_id``, ``group_size`` and ``kept`` to every row.

    Of equal texts the row with the largest id stays. A null text is the empty text. A null id loses to
    any other; if all ids of a group are null, ``keep_id`` is null and all its rows are kept, as nothing
    tells them apart. Rows that repeat an id with an equal text share its verdict. Columns of ``docs``
    that bear the names of the results are replaced; an empty table gives an empty one.
    """
    columns = [c for c in docs.columns if c.lower() not in OUTPUT]
    return mark_digests(docs.select(*columns, digest(text_col).alias("text_sha256")), id_col, max_words)


def mark_digests(hashed: DataFrame, id_col: str = "doc_id", max_words: int = MAX_WORDS) -> DataFrame:
    """As ``mark_duplicates``, for rows that carry their digest as ``text_sha256``."""
    n = hashed.count()
    words = min(max_words, max(1024, 1 << max(0, n.bit_length() - 1)))
    word, mask = bloom_cell(F.col("text_sha256"), words)
    rows = hashed.withColumns({WORD: word, MASK: mask})
    bits = F.broadcast(repeated_bits(rows.select(WORD, MASK)))  # at most max_words rows of 16 bytes
    probed = rows.join(bits, WORD, "left").withColumn(LIVE, F.coalesce(F.col("__bits").bitwiseAND(F.col(MASK)) == F.col(MASK), F.lit(False)))
    probed = probed.drop(WORD, MASK, "__bits")
    single = probed.where(~F.col(LIVE)).drop(LIVE).withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    again = probed.where(LIVE).drop(LIVE)
    groups = again.groupBy(F.col("text_sha256").alias(DIGEST)).agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.hint("rebalance")  # an exchange of its own, so that the join of a large group can be split
    dealt = again.join(groups, F.col("text_sha256") == F.col(DIGEST)).drop(DIGEST).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return single.unionByName(dealt)


def without(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and text (by hash: doc_id, text_name) are not among the lost ones; texts shuffle only where a Bloom filter says they may be."""
    lost = lost.select(F.col("doc_id").alias("__lost"), F.col("text_name").alias("__lost_text"))
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(own[c]) for c in docs.columns]).withColumn("__name", text_name(own[text_col]))
    probed = possibly(rows, lost, "__name", "__lost_text")
    kept = probed.where("maybe").join(lost, F.col(own[id_col]).eqNullSafe(F.col("__lost")) & (F.col("__name") == F.col("__lost_text")), "left_anti")
    return probed.where("NOT maybe").unionByName(kept).select(*[F.col(v).alias(k) for k, v in own.items()])


def text_name(text_col: str) -> Column:
    """A 64-bit name of a text; with an id it tells rows apart."""
    return F.xxhash64(whole(text_col).cast("binary"), F.lit(17))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs`` that ``mark_duplicates`` keeps, with its own columns, whatever their names.

    Whole texts are hashed once: ids and digests are written, and all passes read these. Texts shuffle only where a filter of the rows that go
    says that they may be among them.
    """
    names = docs.select(F.col(id_col).alias("doc_id"), text_name(text_col).alias("text_name"), digest(text_col).alias("text_sha256"))
    names = materialize(names, "digests")
    lost = materialize(mark_digests(names, "doc_id", max_words).where("NOT kept").select("doc_id", "text_name").distinct(), "lost")
    release(names)
    return without(docs, lost, id_col, text_col)
