"""Cost-balanced packing of documents into sequences.

Texts become token ids; whole sequences are cut off long documents and what is left of each document is
dealt by hash to groups of about ``group_sequences`` sequences. In a group the pieces go in descending
order to the sequence of lowest estimated attention cost (linear plus quadratic in the piece's length)
that has room; pieces that fit nowhere are cut into the room that is left. A group opens the fewest sequences
that can hold its tokens, so less than one sequence of padding is spread over all of a group.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.text import bounded_batches, map_rows, whole
from peakloom.session import materialize

CAPACITY, END_ID, GROUP_SEQUENCES, LINEAR, QUADRATIC, MEMO = 4096, 2, 256, 1.0, 1.0 / 2048, 200_000
#: Rows equal in id and text are dealt over so many groups.
SALTS = 64


#: Texts whose words are told apart here just as the tokenizer does: ASCII without other control characters
#: and Latin letters that have no other normal form and one lower-case letter each.
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]*")
LETTERS = r"a-z\u00df-\u00f6\u00f8-\u017e"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\x09-\x0d\x200-9{LETTERS}]+")


class Encoder:
    """Token ids of whole texts.

    The tokenizer lower-cases, drops white space and merges inside words only, so words are encoded once and
    remembered (``memo`` at most; then it starts anew). Words of plain texts are told apart here and go
    through the tokenizer's merges many at a time: a word's last id is one that ends words, which cuts the
    ids apart again. Other texts are cut at ASCII spaces, and any part that is not plain goes through
    the whole tokenizer.
    """

    def __init__(self, path: str, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.merging = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Remember the ids of lower-case words; lines whose ids can't be cut apart are encoded word by word."""
        lines = [new[i : i + 1000] for i in range(0, len(new), 1000)]
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.merging  # the one vocabulary serves both ways
        try:
            merged = self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.steps
        for some, e in zip(lines, merged):
            ids = np.asarray(e.ids, self.kind)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(some):
                self.words.update((w, self.direct(w)) for w in some)
                continue
            data, width = ids.tobytes(), ids.itemsize
            self.words.update(zip(some, (data[a * width : b * width] for a, b in zip([0, *cuts], cuts))))

    def direct(self, part: str) -> bytes:
        """The ids of a part of a text by the whole tokenizer."""
        return np.asarray(self.tokenizer.encode(part, add_special_tokens=False).ids, self.kind).tobytes()

    def split(self, data: bytes) -> tuple[list[str], bool]:
        """The parts of a text and whether all of them are plain words; others are cut at ASCII spaces."""
        text = data.decode("utf-8", "replace")
        if "<|" not in text and PLAIN.fullmatch(text):
            return WORDS.findall(text.lower()), True
        return [p.decode("utf-8", "replace") for p in data.split()], False

    def mixed(self, parts: list[str]) -> bytes:
        """The ids of parts of which some are not plain."""
        out: list[bytes] = []
        for part in parts:
            if "<|" not in part and PLAIN.fullmatch(part):
                words = WORDS.findall(part.lower())
                self.learn([w for w in dict.fromkeys(words) if w not in self.words])
                out += map(self.words.__getitem__, words)
            else:
                out.append(self.direct(part))
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as packed little-endian integers of ``kind``."""
        if len(self.words) > self.memo:
            self.words.clear()
        split = [self.split(x) for x in texts]
        fresh = set().union(*(parts for parts, plain in split if plain)).difference(self.words)
        self.learn(list(fresh))
        known = self.words.__getitem__
        return [b"".join(map(known, parts)) if plain else self.mixed(parts) for parts, plain in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once per worker."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed, without the closing id) and doc_tokens (with it) of each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).cast("binary").alias("__text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = encoder(tokenizer)
        ids = found.encode(batch.column("__text").to_pylist())
        width = np.dtype(found.kind).itemsize
        counts = pa.array([len(x) // width + 1 for x in ids], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), counts, pa.array([width] * len(ids), pa.int32())], names=["doc_id", "ids", "doc_tokens", "width"])

    return map_rows(rows, kernel, rows.select("doc_id").schema.add("ids", "binary").add("doc_tokens", "long").add("width", "integer"), "__text", 1 << 20)


def pack(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) of one group; every token lies in exactly one piece.

    Whole sequences come off the front of each document; the rest is placed in descending order, ties by
    the documents' order. The number of open sequences is the least that can hold the rests.
    """
    pieces, number = [], 0
    rest = lengths % capacity
    for doc in np.flatnonzero(lengths >= capacity).tolist():
        for k in range(int(lengths[doc]) // capacity):
            pieces.append((doc, k * capacity, capacity, number))
            number += 1
    open_ones = -(-int(rest.sum()) // capacity)
    cost, room, over = np.zeros(open_ones), np.full(open_ones, capacity, np.int64), []
    for doc in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[doc])
        if n == 0:
            break
        at = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[at] < n:
            over.append(doc)
            continue
        pieces.append((doc, int(lengths[doc]) - n, n, number + at))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
    slots = iter(np.argsort(-room, kind="stable").tolist())  # the rests that fit nowhere are cut
    at = -1
    for doc in over:
        begin = int(lengths[doc] - rest[doc])
        while begin < lengths[doc]:
            if at < 0 or room[at] == 0:
                at = next(slots)
            n = int(min(room[at], lengths[doc] - begin))
            pieces.append((doc, begin, n, number + at))
            room[at] -= n
            begin += n
    return pieces


def _pack_group(rows: pa.Table, capacity: int, end_id: int) -> pa.Table:
    rows = rows.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending")])
    lengths = rows.column("doc_tokens").to_numpy()
    packed, width = rows.column("ids"), rows.column("width").to_pylist()
    pieces = sorted(pack(lengths, capacity), key=lambda x: (x[3], x[0], x[1]))
    offsets, crcs, filled, doc, ids = [], [], {}, None, None
    order = sorted(range(len(pieces)), key=lambda i: pieces[i][0])
    crc_of = [0] * len(pieces)
    for i in order:
        d, start, n, _ = pieces[i]
        if d != doc:
            kind = "<u2" if width[d] == 2 else "<u4"
            doc, ids = d, np.append(np.frombuffer(packed[d].as_py(), kind).astype("<u4"), np.uint32(end_id)).astype("<u4")
        crc_of[i] = zlib.crc32(ids[start : start + n].tobytes())
    for i, (_, _, n, sequence) in enumerate(pieces):
        offsets.append(filled.get(sequence, 0))
        filled[sequence] = offsets[-1] + n
        crcs.append(crc_of[i])
    at = pa.array([x[0] for x in pieces], pa.int64())
    group = rows.column("group")[0].as_py() if rows.num_rows else 0
    return pa.table(
        {
            "doc_id": rows.column("doc_id").take(at).combine_chunks(),
            "start": pa.array([x[1] for x in pieces], pa.int64()),
            "length": pa.array([x[2] for x in pieces], pa.int64()),
            "ids_crc32": pa.array(crcs, pa.int64()),
            "doc_tokens": rows.column("doc_tokens").take(at).combine_chunks(),
            "sequence_id": pa.array([(group << 32) + x[3] for x in pieces], pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
        }
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_sequences: int = GROUP_SEQUENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the closing id alone. Null ids and repeated rows are packed like any row. An
    empty table gives no pieces. Other columns are not read.
    """
    rows = materialize(tokenize(docs, tokenizer, id_col, text_col), "token-ids")
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    groups = max(1, round(total / (capacity * group_sequences)))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))  # of the written table, so a task that is run again deals alike
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "ids", salt), F.lit(groups)))
    schema = rows.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    return dealt.groupBy("group").applyInArrow(lambda t: _pack_group(t, capacity, end_id), schema)
