"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within ``radius`` bits agree in at least one of radius + 1 blocks, so each fingerprint goes to
the bucket of each of its blocks. In a bucket the fingerprints are sorted by Gray rank; nodes over runs of
neighbours hold the bits that all of them share, upper nodes the bits that their children share. A
search descends from the bucket's root, adds up the differences in the bits each node adds, and drops
whole groups once they exceed the radius. A bucket returns a star for each group it has linked, not its
pairs; the stars are joined to components. Buckets above ``hot`` fingerprints are split by the blocks of
their remaining bits.

``drop_similar`` is for a similarity instead of a radius. At Jaccard 0.8 about ten of 64 bits differ, so blocks that must
agree would have three bits. There the buckets are the least hashes of the shingle sets instead, of which two sets that
similar share one but for about 3 pairs in a million; the index searches each bucket at a wide radius, and shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.exact_dedup import possibly, text_name, without
from peakloom.llm.text import bounded_batches, map_rows, whole
from peakloom.plans.graph import connected_components
from peakloom.session import materialize, release

SHINGLE, RADIUS, FANOUT, HOT, BUCKET_ROWS, SKETCH_ROWS = 3, 3, 8, 4096, 100_000, 16_384
#: For ``drop_similar``: the similarity to catch, at which sets differ in 9.7 of 64 bits (deviation 2.9), and the radius; hashes of a sketch,
#: those of them that name buckets, and the share of a sketch that candidates have in common (0.85 is usual at the least similarity, deviation
#: 0.09); sets of a chunk to verify.
LEAST, WIDE, SKETCH, KEYS, SHARED, SPLIT = 0.8, 22, 16, 8, 0.4, 512
LOW = np.uint64(0x0101010101010101)
SHIFTS = np.arange(8, dtype=np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set, bit 0 first."""
    total = np.zeros((8, 8), np.int64)
    for begin in range(0, len(h), 255):  # bytes count to 255 without overflow
        part = ((h[begin : begin + 255, None] >> SHIFTS) & LOW).sum(0, dtype=np.uint64)
        total += part.view(np.uint8).reshape(8, 8)
    return total.T.reshape(64)  # [byte, bit]


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8: A-Z lower-cased, shingles of ``size`` words, XXH64 with seed 42."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    elif size == 3:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, 42) for x in shingles), np.uint64, len(shingles))
    return int(np.packbits(bit_counts(h) * 2 > len(h), bitorder="little").view(np.uint64)[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The nodes of one or more buckets; leaves sorted by bucket and Gray rank.

    levels[0] holds the leaves; each node above covers up to ``fanout`` neighbours of the same bucket, down to
    one root a bucket. A node has the shared bits (mask) and their values (pattern).
    """

    def __init__(self, bucket: np.ndarray, value: np.ndarray, fanout: int = FANOUT) -> None:
        self.order = order = np.lexsort((gray_rank(value), bucket))
        self.value, group = value[order], bucket[order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        n = len(value)
        first, end = np.arange(n), np.arange(1, n + 1)
        self.levels = [{"all": self.value, "any": self.value, "mask": np.full(n, full), "first": first, "end": end}]
        self.kids: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            low = self.levels[-1]
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
            if not (place > 0).any():
                break
            heads = np.flatnonzero(place % fanout == 0)
            tails = np.r_[heads[1:], len(group)]
            both, some = np.bitwise_and.reduceat(low["all"], heads), np.bitwise_or.reduceat(low["any"], heads)
            self.kids.append((heads, tails))
            self.levels.append({"all": both, "any": some, "mask": both | ~some, "first": low["first"][heads], "end": low["end"][tails - 1]})
            group = group[heads]
        self.root = np.repeat(np.arange(len(group)), self.levels[-1]["end"] - self.levels[-1]["first"])

    def near(self, queries: np.ndarray, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later leaf) within the radius; leaves already known to be linked may be left out."""
        q, node = queries, self.root[queries]
        top = self.levels[-1]
        spent = np.bitwise_count((self.value[q] ^ top["all"][node]) & top["mask"][node]).astype(np.int64)
        held = spent <= radius
        q, node, spent = q[held], node[held], spent[held]
        lowest = [label]
        highest = [label]
        for heads, _ in self.kids:
            lowest.append(np.minimum.reduceat(lowest[-1], heads))
            highest.append(np.maximum.reduceat(highest[-1], heads))
        for depth in range(len(self.levels) - 1, 0, -1):
            level, below = self.levels[depth], self.levels[depth - 1]
            heads, tails = self.kids[depth - 1]
            many = tails[node] - heads[node]
            at = np.repeat(np.arange(len(node)), many)
            child = heads[node][at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            q2, parent = q[at], node[at]
            fresh = (below["end"][child] > q2 + 1) & ~((lowest[depth - 1][child] == highest[depth - 1][child]) & (lowest[depth - 1][child] == label[q2]))
            child, q2, parent, before = child[fresh], q2[fresh], parent[fresh], spent[at][fresh]
            added = below["mask"][child] & ~level["mask"][parent]  # only the bits that this node adds
            before = before + np.bitwise_count((self.value[q2] ^ below["all"][child]) & added)
            held = before <= radius
            q, node, spent = q2[held], child[held], before[held]
        later = node > q
        return q[later], node[later]


    def link(self, radius: int, largest: int, test: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """The smallest leaf of the group of each leaf; pairs within the radius that pass ``test`` join groups."""
        label = np.arange(len(self.value))
        step = 8192 if largest <= 64 else 512
        for begin in range(0, len(label), step):
            a, b = self.near(np.arange(begin, min(begin + step, len(label))), radius, label)
            for i in range(0, len(a), 1 << 16) if test else [0] if len(a) else []:
                p, q = (a[i : i + (1 << 16)], b[i : i + (1 << 16)]) if test else (a, b)
                if test:
                    fresh = label[p] != label[q]
                    p, q = p[fresh], q[fresh]
                    held = test(self.order[p], self.order[q])
                    p, q = p[held], q[held]
                if len(p):
                    label = merge(label, p, q)
        return label


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining each a with its b: the smallest index of each group."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (step := new[new]).tobytes() != new.tobytes():
            new = step
        if (new[a] == new[b]).all():
            return new
        label = new


def link_buckets(bucket: np.ndarray, value: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A star (value, centre) for each set of values that links within some bucket."""
    _, inverse, counts = np.unique(bucket, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    bucket, value = bucket[shared], value[shared]
    if not len(value):
        return value, value
    index = GrayIndex(bucket, value)
    label = index.link(radius, int(counts.max()))
    linked = label != np.arange(len(label))
    return index.value[linked], index.value[label[linked]]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, named: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row, and ``text_name`` if named; a null text has no words."""
    names = [text_name(text_col).alias("text_name")] if named else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *names, whole(text_col).cast("binary").alias("__text"))
    bounded_batches(docs.sparkSession)
    kept = [c for c in rows.columns if c != "__text"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, size) for x in batch.column("__text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found.view(np.int64))], names=[*kept, "fp"])

    schema = rows.select(*kept).schema.add("fp", "long")
    return map_rows(rows, kernel, schema, "__text")


def block_keys(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, fp): one row for each 16-bit block, and four by the other bits where a block's bucket is hot."""
    part = lambda x, at, bits: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1))
    others = []
    for k in range(4):  # the other 48 bits, closed up
        low = F.col("fp").bitwiseAND(F.lit((1 << (16 * k)) - 1)) if k else F.lit(0).cast("long")
        high = F.call_function("shiftleft", F.shiftrightunsigned(F.col("fp"), 16 * k + 16), F.lit(16 * k)) if k < 3 else F.lit(0).cast("long")
        others.append(low.bitwiseOR(high))
    blocks = F.array(*[F.struct((part(F.col("fp"), 16 * k, 16) + (k << 16)).alias("key"), others[k].alias("rest")) for k in range(4)])
    rows = prints.select("fp", F.explode(blocks).alias("x")).select("fp", "x.key", "x.rest")
    busy = rows.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("busy"))
    rows = rows.join(F.broadcast(busy), "key", "left")  # 4 * 65536 keys at most
    finer = F.array(*[part(F.col("rest"), 12 * k, 12) + ((k + 1) << 12) for k in range(4)])
    return rows.select("fp", F.explode(F.when(F.col("busy"), finer).otherwise(F.array(F.lit(0).cast("long")))).alias("sub"), "key").select((F.col("key") * 65536 + F.col("sub")).alias("key"), "fp")


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(node, root) of each distinct fingerprint that links to another one."""
    if radius != RADIUS:
        raise ValueError("the blocks are made for a radius of 3")
    keys = materialize(block_keys(prints, hot), "simhash-keys")
    parts = max(1, -(-keys.count() // BUCKET_ROWS))
    spread = keys.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))

    def kernel(rows: pa.Table) -> pa.Table:
        a, b = link_buckets(rows.column("key").to_numpy(), rows.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return connected_components(spread.groupBy("part").applyInArrow(kernel, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    component_id is the smallest id that links reach, the row itself included. Texts without words have
    fingerprint zero and link like any other; texts under ``size`` words are hashed whole. Null ids are never
    the smallest, unless all are null. Repeated rows get the same class. Other columns are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, size), "simhash")
    return classes(marked, hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def classes(marked: DataFrame, hot: int = HOT) -> DataFrame:
    """Add component_id to rows of doc_id and fp."""
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = link_fingerprints(prints.select("fp"), hot=hot)
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp")


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; shingles are those of ``fingerprint``."""
    words = data.lower().split()
    if len(words) < size:
        shingles = {b" ".join(words)} if words else set()
    else:
        shingles = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, 42) for x in shingles), np.uint64, len(shingles)))


def set_digest(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 43)


def sketch(h: np.ndarray) -> bytes:
    """The least ``SKETCH`` hashes of a set, fewer where it has fewer."""
    return h[:SKETCH].tobytes()


def in_common(low: np.ndarray, many: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many hashes the sketches of each a and b share; ``many`` of each row of ``low`` count."""
    both = np.concatenate([low[a], low[b]], 1)
    both.sort(1)
    return (both[:, 1:] == both[:, :-1]).sum(1) - np.maximum(0, SKETCH - many[a] - 1) - np.maximum(0, SKETCH - many[b] - 1) - ((many[a] < SKETCH) & (many[b] < SKETCH))


def set_prints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, text_name, node (digest of the shingle set), fp (SimHash of the set), n (its size) and sketch of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_name(text_col).alias("text_name"), whole(text_col).cast("binary").alias("__text"))
    bounded_batches(docs.sparkSession)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, fp, n, low = [], [], [], []
        for text in batch.column("__text").to_pylist():
            h = shingle_set(text, size)
            node.append(set_digest(h))
            fp.append(np.packbits(bit_counts(h) * 2 > len(h), bitorder="little").view(np.uint64)[0])
            n.append(len(h))
            low.append(sketch(h))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
        columns = [batch.column("doc_id"), batch.column("text_name"), *longs, pa.array(n, pa.int64()), pa.array(low, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_name", "node", "fp", "n", "sketch"])

    schema = rows.select("doc_id", "text_name").schema.add("node", "long").add("fp", "long").add("n", "long").add("sketch", "binary")
    return map_rows(rows, kernel, schema, "__text")


def similar_stars(sets: list[np.ndarray], least: float, joined_before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A star (row, centre) for each group of sets that links of Jaccard ``least`` or more join; all pairs not yet joined are compared."""
    label, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    if joined_before is not None:
        _, first, at = np.unique(joined_before, return_index=True, return_inverse=True)
        label = first[at]
    names, values = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes  # no set is empty
    for i in range(len(sets) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        mine = np.zeros(len(names), np.int64)
        mine[values[starts[i] : starts[i] + sizes[i]]] = 1
        shared = np.add.reduceat(mine[values[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        held = np.flatnonzero(shared >= least * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9) + i + 1
        if len(held):
            label = merge(label, np.full(len(held), i), held)
    joined = np.flatnonzero(label != np.arange(len(label)))
    return joined, label[joined]


def bucket_stars(keys: DataFrame, prints: DataFrame, radius: int, least: float) -> DataFrame:
    """(a, b): stars of the sets that candidate pairs join in the buckets (key, node).

    A pair of candidates shares a bucket, is within ``radius`` bits, may be as similar as ``least`` by its sizes, and has ``SHARED`` of the
    smaller sketch in common.
    """
    keys = materialize(keys, "sketch-keys")
    parts = max(1, -(-keys.count() // SKETCH_ROWS))
    dealt = keys.join(prints, "node").withColumn("part", F.pmod(F.xxhash64("key", F.lit(9)), F.lit(parts)).cast("int"))

    def kernel(rows: pa.Table) -> pa.Table:
        _, bucket, counts = np.unique(rows.column("key").to_numpy(), return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[bucket] > 1)
        if not len(at):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        rows, bucket = rows.take(at), bucket[at]
        node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        many = np.minimum(n, SKETCH)
        low = np.full((len(n), SKETCH), np.uint64(0xFFFFFFFFFFFFFFFF))
        low[np.arange(SKETCH) < many[:, None]] = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64)

        def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            held = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-6
            held[held] = in_common(low, many, a[held], b[held]) >= SHARED * np.minimum(many[a[held]], many[b[held]])
            return held

        index = GrayIndex(bucket, rows.column("fp").to_numpy().view(np.uint64))
        label = index.link(radius, int(counts.max()), test)
        joined = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[index.order[joined]], "b": node[index.order[label[joined]]]})

    stars = dealt.select("part", "key", "node", "fp", "n", "sketch").groupBy("part").applyInArrow(kernel, "a long, b long")
    stars = materialize(stars, "bucket-stars")
    release(keys)
    return stars


def candidates(prints: DataFrame, radius: int = WIDE, least: float = LEAST, hot: int = HOT) -> DataFrame:
    """(a, b): stars of the sets that chains of candidate pairs join.

    Every set is in the buckets of its ``KEYS`` least hashes. A hash that more than ``hot`` sets share is dealt in three steps. Its sets are
    linked inside chunks of about ``hot``; then one set of each class of the chunks stands for it, so that a large group of near
    copies is one class by now. Hashes whose sets are still of several classes, such as those of a passage that unlike texts
    share, are taken in pairs: two sets of the similarity that share no other key share two of them. Pairs that are
    hot too are dealt over chunks, and all pairs of chunks are buckets: no link is lost to a bucket's size, and only there comparisons
    grow with the square of it.
    """
    some = prints.where("n > 0").select("node", "fp", "n", "sketch")
    slots = F.transform(F.sequence(F.lit(0), F.lit(KEYS - 1)), lambda i: F.substring(F.col("sketch"), i * 8 + 1, F.lit(8)))
    rows = some.select("node", F.explode(F.filter(slots, lambda x: F.octet_length(x) > 0)).alias("h")).select("node", F.xxhash64("h").alias("key"))
    busy = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.ceil(F.col("n") / hot).cast("int").alias("chunks"))
    busy = materialize(busy, "busy-keys")
    if not busy.limit(1).count():
        return bucket_stars(rows, some, radius, least)
    marked = rows.join(busy, "key", "left")
    found = [bucket_stars(marked.where("chunks IS NULL").select("key", "node"), some, radius, least)]
    crowd = materialize(marked.where("chunks IS NOT NULL").select("key", "node", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int").alias("chunk")), "busy-rows")
    found.append(bucket_stars(crowd.select(F.xxhash64("key", "chunk").alias("key"), "node"), some, radius, least))

    def classed() -> DataFrame:
        roots = connected_components(reduce(DataFrame.unionByName, found))
        return materialize(crowd.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label")), "busy-classes")

    chunked = classed()
    heads = chunked.groupBy("key", "label").agg(F.min("node").alias("node"))
    heads = heads.join(heads.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("int").alias("chunks")), "key")
    heads = heads.select(F.xxhash64("key", F.pmod(F.xxhash64("node", F.lit(8)), F.col("chunks"))).alias("key"), "node")
    found.append(bucket_stars(heads, some, radius, least))
    sorted_out = classed()
    several = sorted_out.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a != z").select("key")
    own = sorted_out.join(several, "key").groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("own"))  # KEYS at most
    pairs = F.flatten(F.transform("own", lambda g, i: F.transform(F.slice("own", i + 2, KEYS), lambda h: F.xxhash64(g, h))))
    pairs = own.select("node", F.explode(pairs).alias("key"))
    sizes = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / hot).cast("int").alias("chunks"))
    pairs = pairs.join(sizes.hint("rebalance"), "key").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (j != F.col("mine")) | (F.col("chunks") == 1))
    dealt = pairs.withColumn("other", F.explode(others))
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node")
    found.append(bucket_stars(dealt, some, radius, least))
    release(busy, crowd, chunked, sorted_out)
    return reduce(DataFrame.unionByName, found)


def cell_stars(dealt: DataFrame, parts: int, least: float) -> DataFrame:
    """(a, b): stars over the sets of each cell (columns cell, node, label, hashes); sets of one label are joined already."""
    spread = dealt.withColumn("part", F.pmod("cell", F.lit(parts)).cast("int"))

    def kernel(rows: pa.Table) -> pa.Table:
        node, cell, label, hashes = (rows.column(c) for c in ("node", "cell", "label", "hashes"))
        node, cell, label = node.to_numpy(), cell.to_numpy(), label.to_numpy()
        order = np.argsort(cell, kind="stable")
        a, b = [], []
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            x, y = similar_stars([np.frombuffer(hashes[int(i)].as_py(), np.uint64) for i in at], least, label[at])
            a.append(node[at[x]])
            b.append(node[at[y]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return spread.select("part", "cell", "node", "label", "hashes").groupBy("part").applyInArrow(kernel, "a long, b long")


def chunk_pairs(sets: DataFrame, split: int) -> DataFrame:
    """Sets (node, root, label, hashes) dealt to the pairs of chunks of their group."""
    many = sets.groupBy("root").agg(F.ceil(F.count("*") / split).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (j != F.col("mine")) | (F.col("chunks") == 1))
    dealt = sets.join(many, "root").withColumn("mine", mine).withColumn("other", F.explode(others))
    return dealt.select("node", "label", "hashes", F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))


def similar_links(docs: DataFrame, prints: DataFrame, groups: DataFrame, id_col: str, text_col: str, size: int, least: float = LEAST, split: int = SPLIT) -> DataFrame:
    """(a, b): stars over the sets of a group (node, root) that Jaccard links of ``least`` or more join; sets are read from one text of each.

    Groups of up to ``split`` sets are compared in one task. Larger ones are first joined inside chunks, then by one set of each class so found; only
    where a group then still has several classes, all pairs of its chunks are compared, but for sets of one class. Texts
    shuffle only where a bounded Bloom filter says that they take part.
    """
    wanted = materialize(prints.join(groups, "node").select("node", "root", F.col("least_id").alias("__id")), "similar-members")
    texts = docs.select(F.col(id_col).alias("__id"), whole(text_col).cast("binary").alias("__text"))
    texts = possibly(texts, wanted, "__id", "__id").where("maybe").join(wanted, "__id").select("node", "root", "__text")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(x, size) for x in batch.column("__text").to_pylist()]
        names = np.array([set_digest(h) for h in found], np.uint64).view(np.int64)
        same = pa.array(names == batch.column("node").to_numpy())  # an id may be that of several texts
        return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array([h.tobytes() for h in found], pa.binary()), same], names=["node", "root", "hashes", "same"])

    sets = map_rows(texts, read, "node long, root long, hashes binary, same boolean", "__text").where("same").dropDuplicates(["node"])
    sets = materialize(sets.select("node", "root", "hashes"), "shingle-sets")
    parts = max(1, -(-sets.count() // split))
    many = sets.groupBy("root").agg(F.ceil(F.count("*") / split).cast("int").alias("chunks"))
    own = sets.join(many, "root").withColumn("cell", F.xxhash64("root", F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks"))))
    found = [materialize(cell_stars(own.withColumn("label", F.col("node")), parts, least), "chunk-stars")]
    large = materialize(many.where("chunks > 1").select("root"), "large-groups")
    if large.limit(1).count():
        hard = materialize(sets.join(large, "root"), "large-sets")

        def classed() -> DataFrame:
            roots = connected_components(reduce(DataFrame.unionByName, found)).withColumnRenamed("root", "label")
            return materialize(hard.select("node", "root").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")), "large-classes")

        heads = classed()
        found.append(materialize(cell_stars(chunk_pairs(hard.join(heads.where("label = node"), ["node", "root"]), split), parts, least), "head-stars"))
        sorted_out = classed()
        several = sorted_out.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a != z").select("root")
        rest = hard.join(sorted_out.join(several, "root"), ["node", "root"])
        found.append(materialize(cell_stars(chunk_pairs(rest, split), parts, least), "pair-stars"))
        release(hard, heads, sorted_out)
    release(wanted, sets, large)
    return reduce(DataFrame.unionByName, found)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, radius: int = WIDE, least: float = LEAST, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class of texts that links of Jaccard ``least`` or more join.

    SimHash at the wide radius finds candidates in buckets of shared least hashes, and the shingles of the pairs of a group of
    candidates decide. Texts of the same shingles, texts without words among them, link; rows with a null id all stay and link nothing.
    Rows that repeat an id with another text are judged by their own text, and rows that repeat id and text stay or go together.
    Null texts are empty; an empty table gives an empty one; the columns are those of ``docs``.
    """
    named = docs.where(F.col(id_col).isNotNull())
    marked = materialize(set_prints(named, id_col, text_col, size), "shingle-prints")
    prints = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "shingle-nodes")
    groups = connected_components(candidates(prints, radius, least, hot))
    roots = connected_components(similar_links(named, prints, groups, id_col, text_col, size, least, split))
    rooted = materialize(prints.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root")), "roots")
    best = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classed = marked.select("doc_id", "node", "text_name").join(rooted.join(best, "root").select("node", "component_id"), "node")
    lost = materialize(classed.where("doc_id > component_id").select("doc_id", "text_name").distinct(), "lost")
    release(marked, prints, rooted)
    return without(docs, lost, id_col, text_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class of ``near_duplicates``.

    Rows with a null id all stay. Rows that repeat an id with another text are judged by their own fingerprint.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, size, named=True), "simhash")
    lost = materialize(classes(marked, hot).where("doc_id > component_id").select("doc_id", "text_name").distinct(), "lost")
    release(marked)
    return without(docs, lost, id_col, text_col)
