"""Repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``width`` bytes of a suffix matter, so suffixes are split by most-significant-digit passes and
a suffix leaves as soon as it is alone; groups that are left after the last pass are the repeated windows. Equality does not
depend on the order in which a window's bytes are looked at, and here the first digit is not its first bytes but its anchor: so the
first pass moves one row for a run of windows instead of one for each byte.

Pass 1. The digit of a window is its least hashed gram of ``GRAM`` bytes (leftmost on ties). Equal windows
agree in it and in its place, so neighbouring windows with one such anchor travel as one block. Equal blocks of one text
are folded at once: all their windows are repeated, and one block goes on for them.
Pass 2. In groups whose blocks are not all equal, the digit is the whole block: windows of equal blocks are
repeated. One block of each kind goes on; it stands for all windows of its kind.
Pass 3. The digit is the part that the windows of a class (``CLASS`` neighbouring offsets from the anchor) share.
Pass 4. The digit is the rest of each window, taken literally.

Digits longer than a few bytes are compared by hashes: blocks by the anchor's 64 bits and 128 bits more, shared parts by the anchor's 64 bits and 64
bits more. Every pass counts digits with a partial aggregation before it shuffles, and hands the counts back through
joins that Spark can split, so that no group is held by one task. Texts shuffle only where a bounded
Bloom filter says that the document takes part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.exact_dedup import possibly
from peakloom.llm.text import bounded_batches, map_rows, slim, whole
from peakloom.session import materialize, release

WIDTH, GRAM, CLASS, SEGMENT, OUT_ROWS = 400, 128, 32, 1 << 20, 1 << 16
TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP, FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of each string of ``size`` bytes (a power of two)."""
    return run_hashes(TABLE[data], size)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashes (a power of two), by doubling."""
    have = 1
    while have < size:
        h = h[:-have] * STEP + h[have:]
        h ^= h >> FOLD
        have *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


BLOCK = ("core", "slice", "more", "lo", "hi", "at")


def anchored_blocks(text: bytes, width: int = WIDTH) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the runs of windows lo..hi with the anchor ``at``: its hash core and 128 bits of the block's hash.

    Long texts are cut into segments of windows, each a result of its own; a block at a cut is shorter, which no later pass minds.
    """
    for begin in range(0, max(0, len(text) - width + 1), SEGMENT):
        data = np.frombuffer(text, np.uint8)[begin : begin + SEGMENT + width - 1]
        h = gram_hashes(data)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, width - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        hi = np.r_[lo[1:], len(at)] - 1
        part = text[begin : begin + len(data)]
        digest = b"".join([xxhash.xxh3_128_digest(part[i : j + width]) for i, j in zip(lo.tolist(), hi.tolist())])
        halves = np.frombuffer(digest, ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
        yield dict(zip(BLOCK, (h[at[lo]].view(np.int64), halves[:, 0], halves[:, 1], lo + begin, hi + begin, at[lo] + begin)))


def folded(blocks: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of one block of each kind, how often each is there, and the windows (lo, hi) of those that come more than once, joined where they touch."""
    order = np.lexsort((blocks["slice"], blocks["more"]))
    a, b = blocks["slice"][order], blocks["more"][order]
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    times = np.diff(np.r_[head, len(order)])
    again = np.sort(order[np.repeat(times > 1, times)])
    lo, hi = blocks["lo"][again], blocks["hi"][again]
    first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1] + 1]) if len(lo) else np.zeros(0, np.int64)
    return order[head], times, np.stack([lo[first], hi[np.r_[first[1:], len(lo)] - 1]], 1) if len(lo) else np.zeros((0, 2), np.int64)


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> tuple[list[pa.Array], list[str]]:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return [pa.array(c, k) for c, k in zip(columns, kinds)], names


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (as bytes) and two hashes k1, k2 that tell the rows apart; equal rows share them."""
    text = whole(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})


def block_table(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """The blocks of all texts: k1, k2, core, slice, more, lo, hi, at, times (in the segment of the text).

    Rows without a core are windows that are known to be repeated inside their text.
    """
    bounded_batches(rows.sparkSession)
    names = ["k1", "k2", *BLOCK, "times"]
    kinds = dict.fromkeys(names, pa.int64()) | dict.fromkeys(("lo", "hi", "at", "times"), pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0

        def close() -> pa.RecordBatch:
            columns = []
            for c in names:
                values = np.concatenate([x[c] for x in held])
                hidden = np.concatenate([x["times"] == 0 for x in held]) if c in BLOCK and c not in ("lo", "hi") else None
                columns.append(pa.array(values, kinds[c], mask=hidden))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slim(batches, "text"):
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
                for blocks in anchored_blocks(text, width):
                    at, times, again = folded(blocks)
                    made = {c: np.r_[blocks[c][at], again[:, k] if (k := {"lo": 0, "hi": 1}.get(c)) is not None else np.zeros(len(again), np.int64)] for c in BLOCK}
                    made["times"] = np.r_[times, np.zeros(len(again), np.int64)]
                    held.append(made | {"k1": np.full(len(made["times"]), k1), "k2": np.full(len(made["times"]), k2)})
                    count += len(made["times"])
                    if count >= OUT_ROWS:
                        yield close()
                        held, count = [], 0
        if held:
            yield close()

    long_ones = rows.where(F.octet_length("text") >= width).select("k1", "k2", "text")
    return long_ones.mapInArrow(run, "k1 long, k2 long, core long, slice long, more long, lo int, hi int, at int, times int")


def split_classes(text: bytes, ranges: list[dict], width: int = WIDTH) -> list[tuple]:
    """(core, cls, head, tail, first, last, base, open) of each class of windows in the ranges of a text.

    Window j of a class begins at base - j. All share ``width - CLASS + 1`` bytes from base on; window j
    also has the last j bytes of ``head`` and the first CLASS - 1 - j of ``tail``.
    """
    out, common = [], width - CLASS + 1
    for r in ranges:
        for c in range((r["at"] - r["hi"]) // CLASS, (r["at"] - r["lo"]) // CLASS + 1):
            base = r["at"] - c * CLASS
            first, last = max(0, base - r["hi"]), min(CLASS - 1, base - r["lo"])
            shared = xxhash.xxh3_64_intdigest(text[base : base + common], seed=c) - (1 << 63)
            out.append((r["core"], shared, text[base - last : base], text[base + common : base - first + width], first, last, base, r["open"]))
    return out


def class_table(rows: DataFrame, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pass 3's rows for the ranges (k1, k2, core, lo, hi, at, open) of documents."""
    lists = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("core", "lo", "hi", "at", "open")).alias("ranges"))
    texts = possibly(rows, ranges, "k1", "k1").where("maybe").select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owner = [], []
        for i, (text, some) in enumerate(zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist())):
            mine = split_classes(text, some, width)
            found += mine
            owner += [i] * len(mine)
        arrays, names = _columns(found, ["core", "cls", "head", "tail", "first", "last", "base", "open"], kinds)
        at = pa.array(owner, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("k1").take(at), batch.column("k2").take(at), *arrays], names=["k1", "k2", *names])

    joined = texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "ranges")
    return map_rows(joined, kernel, "k1 long, k2 long, core long, cls long, head binary, tail binary, first int, last int, base int, open boolean")


def repeated_windows(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """k1, k2 and the runs (lo, hi) of window starts whose windows occur elsewhere too; runs may overlap.

    Copies of a row give the same runs, which are held once.
    """
    blocks = materialize(block_table(rows, width), "blocks")
    inside = blocks.where("core IS NULL")
    kind = F.struct("slice", "more")
    cores = blocks.where("core IS NOT NULL").groupBy("core").agg(
        F.sum("times").alias("n"), *[f(c).alias(f"{c}_{k}") for c in ("slice", "more") for f, k in ((F.min, "a"), (F.max, "z"))]
    )
    cores = cores.where("n > 1").select("core", ((F.col("slice_a") == F.col("slice_z")) & (F.col("more_a") == F.col("more_z"))).alias("uniform"))
    hits = materialize(blocks.join(cores.hint("rebalance"), "core"), "block-hits")
    mixed = hits.where("NOT uniform")
    kinds = mixed.groupBy("core", kind.alias("kind")).agg(F.sum("times").alias("n"), F.min_by(F.struct("k1", "k2", "lo", "hi", "at"), "k1").alias("one"))
    kinds = materialize(kinds, "block-kinds")
    many = kinds.where("n > 1").select("core", "kind.slice", "kind.more")
    again = mixed.join(many, ["core", "slice", "more"])
    ranges = kinds.select("core", (F.col("n") == 1).alias("open"), "one.k1", "one.k2", "one.lo", "one.hi", "one.at")
    classes = materialize(class_table(rows, ranges, width), "window-classes")
    whole_class = F.xxhash64("head", "tail", "first", "last")
    counts = classes.groupBy("core", "cls").agg(F.count("*").alias("n"), F.min(whole_class).alias("a"), F.max(whole_class).alias("z"))
    counts = counts.where("n > 1").select("core", "cls", (F.col("a") == F.col("z")).alias("uniform"))
    left = materialize(classes.join(counts.hint("rebalance"), ["core", "cls"]), "class-hits")
    alike = left.where("uniform AND open").select("k1", "k2", (F.col("base") - F.col("last")).alias("lo"), (F.col("base") - F.col("first")).alias("hi"))
    each = left.where("NOT uniform").withColumn("j", F.explode(F.sequence("first", "last")))
    rest = F.expr(f"concat(substring(head, length(head) - j + 1, j), substring(tail, 1, {CLASS - 1} - j))")
    each = each.select("core", "cls", "j", rest.alias("rest"), "k1", "k2", (F.col("base") - F.col("j")).alias("lo"), "open")
    digits = ["core", "cls", "j", "rest"]
    equal = each.groupBy(*digits).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    single = each.where("open").join(equal.hint("rebalance"), digits).select("k1", "k2", "lo", F.col("lo").alias("hi"))
    found = [x.select("k1", "k2", "lo", "hi") for x in (inside, hits.where("uniform"), again, alike, single)]
    runs = reduce(DataFrame.unionByName, found).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    runs = materialize(runs, "window-runs")
    release(blocks, hits, kinds, classes, left)
    return runs


def cut_spans(text: bytes, runs: list[dict], width: int = WIDTH) -> tuple[list[tuple[int, int]], bytes]:
    """The removed spans (begin, end) of a text and what is left of it."""
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, [r["lo"] for r in runs], 1)
    np.add.at(edge, [r["hi"] + width for r in runs], -1)
    gone = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    turns = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
    spans = list(zip(turns[::2], turns[1::2]))
    ends = [0, *(e for _, e in spans)]
    return spans, b"".join(text[a:b] for a, b in zip(ends, [*(b for b, _ in spans), len(text)]))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of begin and end in bytes), kept_text (bytes), n_bytes and the row's name k1, k2 of each row.

    Each byte covered by a string of ``width`` bytes that also starts anywhere else is removed, the first
    occurrence included. Null texts are empty; texts under ``width`` bytes stay whole; repeated rows are
    occurrences of each other. Spans are null where nothing is removed. Other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    runs = repeated_windows(rows, width)
    probed = possibly(rows, runs, "k1", "k1")
    none = F.lit(None).cast("array<struct<begin:int,end:int>>")
    straight = probed.where("NOT maybe").select("k1", "k2", "doc_id", none.alias("spans"), F.col("text").alias("kept_text"), F.octet_length("text").alias("n_bytes"))
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, kept, sizes = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            cut, rest = cut_spans(text, found, width) if found else (None, text)
            spans.append(cut and [{"begin": a, "end": b} for a, b in cut])
            kept.append(rest)
            sizes.append(len(text))
        same = [batch.column(c) for c in ("k1", "k2", "doc_id")]
        return pa.RecordBatch.from_arrays([*same, pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(sizes, pa.int32())], names=["k1", "k2", "doc_id", "spans", "kept_text", "n_bytes"])

    cut = probed.where("maybe").join(runs, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "runs")
    return straight.unionByName(map_rows(cut, kernel, straight.schema))


#: Words of a shared window, of its anchor, and words of the filter of anchors (8 bytes each).
PASSAGE, ANCHOR, ANCHOR_WORDS = 51, 16, 1 << 20


def word_windows(text: bytes, window: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (two columns) and the anchor of each window of words: its least run of ``ANCHOR`` words by hash."""
    words = text.split()
    if len(words) < window:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    short, half = run_hashes(h, ANCHOR), 1 << (window.bit_length() - 1)
    long = run_hashes(h, half)
    a, b = long[: len(words) - window + 1], long[window - half :]  # two runs that cover the window
    both = np.stack([(a ^ (b >> FOLD)) * STEP + b, (b ^ (a >> FOLD)) * TABLE[0] + a * TABLE[1]], 1)
    return both, sliding_min(short, window - ANCHOR + 1)


def anchor_cell(core: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter of anchors and the mask of two bits of an anchor."""
    one = np.uint64(1)
    return (core & np.uint64(words - 1)).astype(np.int64), (one << ((core >> np.uint64(40)) & np.uint64(63))) | (one << ((core >> np.uint64(46)) & np.uint64(63)))


def word_blocks(text: bytes, window: int = PASSAGE) -> np.ndarray:
    """The distinct runs of windows of one anchor: the anchor and a hash of the run's windows."""
    both, core = word_windows(text, window)
    if not len(core):
        return np.zeros((0, 2), np.uint64)
    head = np.flatnonzero(np.r_[True, core[1:] != core[:-1]])
    kind = [xxhash.xxh3_64_intdigest(both[i:j].tobytes()) for i, j in zip(head.tolist(), [*head[1:].tolist(), len(core)])]
    return np.unique(np.stack([core[head], np.array(kind, np.uint64)], 1), axis=0)


def shared_passages(rows: DataFrame, window: int = PASSAGE, words: int = ANCHOR_WORDS) -> DataFrame:
    """k1 and k2 of the documents that have a window of ``window`` words which another document has too.

    White space between words does not count. Neighbouring windows of one anchor travel as one run, as in the passes over bytes. A document that has a run
    which another one has too is found. Where others share an anchor only, single windows are compared: a second pass over the texts makes
    rows of the windows of one anchor in two documents of each kind of run, which a filter of ``words`` words (broadcast)
    picks. Beyond the filter's capacity more windows become rows, and what is found stays the same.
    """
    bounded_batches(rows.sparkSession)
    signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    texts = rows.where(F.octet_length("text") >= 2 * window - 1).select("k1", "k2", "text")

    def emit(batches: Iterable[pa.RecordBatch], some: Callable[[bytes, int], np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches, "text", 4 << 20):
            found = [some(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("k1").to_pylist())]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            made = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(owner), batch.column("k2").take(owner), signed(made[:, 0]), signed(made[:, 1])], names=["k1", "k2", *names])

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(batches, lambda t, _: word_blocks(t, window), ["core", "kind"])

    blocks = materialize(texts.mapInArrow(runs, "k1 long, k2 long, core long, kind long"), "word-blocks")
    cores = blocks.groupBy("core").agg(F.min("k1").alias("a"), F.max("k1").alias("z")).where("a != z").select("core")
    hits = materialize(blocks.join(cores.hint("rebalance"), "core"), "word-hits")
    kinds = materialize(hits.groupBy("core", "kind").agg(F.min("k1").alias("a"), F.max("k1").alias("z")), "word-kinds")
    many = kinds.where("a != z").select("core", "kind")
    sure = materialize(hits.join(many.hint("rebalance"), ["core", "kind"]).select("k1", "k2").distinct(), "shared-runs")
    open_ones = hits.join(sure, ["k1", "k2"], "left_anti").select("core").distinct()
    both_ends = F.transform(F.array_distinct(F.array("a", "z")), lambda k: k.bitwiseXOR(F.col("core")))
    wanted = kinds.join(open_ones, "core").select(F.explode(both_ends).alias("key"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("key", at).bitwiseAND(F.lit(63)).cast("int"))
    cells = wanted.groupBy(F.col("key").bitwiseAND(F.lit(words - 1)).alias("word")).agg(F.bit_or(bit(40).bitwiseOR(bit(46))).alias("bits"))
    held = cells.toPandas()  # ``words`` rows at most
    bits = np.zeros(words, np.int64)
    bits[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(text: bytes, k1: int) -> np.ndarray:
            both, core = word_windows(text, window)
            at, mask = anchor_cell(core ^ np.int64(k1).astype(np.uint64), words)
            return np.unique(both[(shared.value[at] & mask) == mask], axis=0)

        return emit(batches, some, ["w1", "w2"])

    made = materialize(texts.mapInArrow(windows, "k1 long, k2 long, w1 long, w2 long"), "word-windows")
    common = made.groupBy("w1", "w2").agg(F.min("k1").alias("a"), F.max("k1").alias("z")).where("a != z").select("w1", "w2")
    found = made.join(common.hint("rebalance"), ["w1", "w2"]).select("k1", "k2").unionByName(sure).distinct()
    found = materialize(found, "shared-passages")
    release(blocks, hits, kinds, sure, made)
    return found


def digest_repeats(removed: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """The query's columns from the rows of ``remove_repeats``, and shares_passage: whether it is among those of ``shared_passages``."""
    kept = F.col("kept_text")
    out = removed.select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), (F.col("n_bytes") - F.octet_length(kept)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), "k1", "k2",
    )
    if passages is not None:
        out = out.join(passages.withColumn("shares_passage", F.lit(True)), ["k1", "k2"], "left").withColumn("shares_passage", F.coalesce("shares_passage", F.lit(False)))
    return out.drop("k1", "k2")
