"""Document quality by supervised subword embeddings.

A text is its words, its pairs of neighbouring words (a pair of equal words also as a pair of any word and a ditto
mark, so that it means the same for any word) and its words' character n-grams, each hashed to a row of an embedding
table. The mean of the rows, over ``REST`` empty ones too so that short texts stay near the bias, goes through a softmax layer of two outputs; table and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled documents. Scoring needs only the difference of the two
outputs, which is linear in the mean: so the table folds into one number a row, and a word's sum over its
subwords is remembered.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.text import bounded_batches, map_rows, whole

BUCKETS, DIM, GRAMS, EPOCHS, RATE, THRESHOLD, MEMO, REST = 1 << 17, 16, (3, 4), 6, 0.4, 0.7, 300_000, 40
#: Grams of a word at a time, and bytes of words to remember.
SEGMENT, MEMO_BYTES = 1 << 14, 64 << 20
#: The training sample: so many labelled rows at most, of any length. Their texts stay on the executors; the driver gets counts of rows of the table.
TRAIN_ROWS = 3000


def features(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Rows of a word: the word itself and the character n-grams of it between brackets."""
    text = (b"<" + word + b">").decode("utf-8", "replace")
    out = [zlib.crc32(word) % buckets]
    for n in GRAMS:
        out += [zlib.crc32(text[i : i + n].encode(), n) % buckets for i in range(len(text) - n + 1)]
    return out


def segments(word: bytes, buckets: int = BUCKETS) -> Iterator[list[int]]:
    """The rows of ``features`` in lists of bounded length."""
    if len(word) <= SEGMENT:
        yield features(word, buckets)
        return
    text = (b"<" + word + b">").decode("utf-8", "replace")
    yield [zlib.crc32(word) % buckets]
    for n in GRAMS:
        for begin in range(0, len(text) - n + 1, SEGMENT):
            yield [zlib.crc32(text[i : i + n].encode(), n) % buckets for i in range(begin, min(begin + SEGMENT, len(text) - n + 1))]


def pair_rows(first: np.ndarray, second: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The rows of pairs of words, each word given by its CRC-32."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def ditto_row(buckets: int = BUCKETS) -> int:
    """The row of a pair of equal neighbours."""
    return zlib.crc32(b"\x00ditto") % buckets


@dataclass
class Model:
    """A trained model, folded: the weight of each row and the bias of the difference of the outputs."""

    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums, self.counts, self.names = (np.zeros(1 << 12, kind) for kind in (np.float64, np.int64, np.uint32))
        self.held = 0  # bytes of the known words

    def __getstate__(self) -> dict:
        return {"weight": self.weight, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def learn(self, w: bytes) -> None:
        """Remember the sum over a word's rows, their number and its CRC-32."""
        at = len(self.known)
        if at == len(self.sums):
            self.sums, self.counts, self.names = (np.r_[x, np.zeros_like(x)] for x in (self.sums, self.counts, self.names))
        total, count = 0.0, 0
        for rows in segments(w, len(self.weight)):
            total += float(self.weight[rows].sum(dtype=np.float64))
            count += len(rows)
        self.known[w], self.sums[at], self.counts[at], self.names[at] = at, total, count, zlib.crc32(w)
        self.held += len(w)

    def score(self, text: bytes) -> float:
        """Probability of label 1; a text without words has that of the bias alone."""
        words = text.split()
        if len(self.known) > MEMO or self.held > MEMO_BYTES:
            self.__post_init__()
        z = self.bias
        if words:
            for w in set(words).difference(self.known):
                self.learn(w)
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            names, same = self.names[at], int((at[1:] == at[:-1]).sum())
            total = self.sums[at].sum() + self.weight[pair_rows(names[:-1], names[1:], len(self.weight))].sum(dtype=np.float64)
            total += same * float(self.weight[ditto_row(len(self.weight))])
            z += total / (int(self.counts[at].sum()) + len(words) - 1 + same + REST)
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -30, 30))))


def text_rows(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a text and how often it has each."""
    words = text.split()
    total = np.zeros(buckets, np.int64)
    for w, n in Counter(words).items():
        for rows in segments(w, buckets):
            np.add.at(total, rows, n)
    names = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    np.add.at(total, pair_rows(names[:-1], names[1:], buckets), 1)
    total[ditto_row(buckets)] += sum(map(eq, words, words[1:]))
    found = np.flatnonzero(total)
    return found, total[found]


def train(texts: list[bytes], labels: list[int], **options) -> Model:
    """Fit to texts; see ``fit``."""
    return fit([text_rows(t, options.get("buckets", BUCKETS)) for t in texts], labels, **options)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE, buckets: int = BUCKETS, dim: int = DIM) -> Model:
    """Fit the embeddings and the softmax layer to the rows of texts; without examples of both labels the bias decides."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return Model(np.zeros(buckets, np.float32), float(np.log(prior / (1 - prior))))
    docs = [(found.astype(np.int32), (counts / (counts.sum() + REST)).astype(np.float32)) for found, counts in rows]
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.log(np.array([1 - prior, prior])).astype(np.float32)
    balance = np.array([0.5 / (1 - prior), 0.5 / prior], np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            step = rate * (1 - done / steps) * balance[y[i]]
            done += 1
            mean = share @ table[ids] if len(ids) else np.zeros(dim, np.float32)
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y[i]] -= 1
            back = layer @ error
            layer -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            if len(ids):
                table[ids] -= step * share[:, None] * back * len(ids) ** 0.5
    return Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from: the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Table rows (with counts) and labels of a hash-ordered sample of the labelled documents that are not held out.

    Of an id's labels the largest counts, of its texts the one whose hash is least. Whole texts are read, on the executors.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    some = known.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id", F.lit(3)), "__id").limit(rows)
    text = whole(text_col).cast("binary")
    found = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).join(F.broadcast(some), "__id")  # at most ``rows`` rows
    bounded_batches(docs.sparkSession)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [text_rows(t) for t in batch.column("__text").to_pylist()]
        names = pa.array([zlib.crc32(t) for t in batch.column("__text").to_pylist()], pa.int64())
        packed = [pa.array([x[k].astype("<i4").tobytes() for x in made], pa.binary()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), names, *packed], names=["__id", "__label", "name", "rows", "counts"])

    schema = found.select("__id", "__label").schema.add("name", "long").add("rows", "binary").add("counts", "binary")
    taken = map_rows(found, kernel, schema, "__text").groupBy("__id").agg(F.min(F.struct("name", "rows", "counts", "__label")).alias("x")).collect()
    taken.sort(key=lambda r: r[0])
    return [(np.frombuffer(r.x.rows, "<i4"), np.frombuffer(r.x.counts, "<i4")) for r in taken], [int(r.x["__label"] == 1) for r in taken]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; a null text is empty, other columns are not read."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), whole(text_col).cast("binary").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes for each of the fixed number of buckets

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value
        scores = pa.array([found.score(t) for t in batch.column("__text").to_pylist()], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], names=["doc_id", "held_out", "score"])

    schema = rows.select("doc_id", "held_out").schema.add("score", "double")
    return map_rows(rows, kernel, schema, "__text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Train on the labelled sample and score every row.

    Null and empty texts have the score of the bias alone, repeated rows are scored alike, a null id is never held out and has no
    label, an empty table gives no rows, and without labels of both kinds all scores are equal.
    """
    rows, found = training_sample(docs, labels, id_col, text_col, label_col)
    return score_documents(docs, fit(rows, found), id_col, text_col)
