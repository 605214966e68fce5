"""WARC archives with dictionary-compressed records.

Each archive starts with a skippable Zstandard frame that holds a dictionary built from the archive's own
records; every record follows as a frame of its own. Of records with equal payloads the one with the
smallest id is a response; the others are revisits that name it and carry no payload. Payloads are
compared by two digests and their length. Ids and digests shuffle; of the payloads only those that a bounded Bloom filter
takes for revisits.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.exact_dedup import possibly
from peakloom.llm.text import bounded_batches, whole
from peakloom.session import materialize, scratch

SKIPPABLE, DICT_BYTES, ARCHIVE_BYTES, LEVEL = 0x184D2A5D, 32 << 10, 16 << 20, 3
#: The dictionary is trained on pieces of so many bytes, evenly spaced over all records of the archive, of so many bytes together.
PIECE, SAMPLE_BYTES = 2048, 2 << 20
#: Tasks that read archives, at most.
TASKS = 20_000
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def format_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; the length of a revisit's payload is kept in a header of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_urn(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE.decode()}", f"WARC-Refers-To: <{record_urn(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sample_pieces(records: list[bytes], piece: int = PIECE, most: int = SAMPLE_BYTES) -> list[bytes]:
    """Pieces evenly spaced over the records, taken as one string of bytes; all of it where it is no more than ``most``."""
    total = sum(map(len, records))
    if total <= most:
        return [r[i : i + piece] for r in records for i in range(0, len(r), piece)]
    stride = -(-total * piece // most)
    out, at = [], 0  # at: where the next piece begins, from the start of this record
    for r in records:
        while at < len(r):
            out.append(r[at : at + piece])
            at += stride
        at -= len(r)
    return out


def build_dictionary(records: list[bytes], most: int = DICT_BYTES) -> bytes:
    """A dictionary trained on pieces of the records; the pieces themselves serve where there are too few to train on."""
    samples = sample_pieces(records)
    try:
        return zstandard.train_dictionary(min(most, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:most]


def format_archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """A whole archive: the dictionary's frame and a frame for each record."""
    dictionary = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary + b"".join(map(packer.compress, records))


def iterate_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest, at = memoryview(data), 8 + size
    while at < len(rest):
        one, parts = context.decompressobj(), []
        while not one.eof:  # in steps, as what is left of a step is copied
            step = rest[at : at + (1 << 14)]
            if not len(step):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(step))
            at += len(step) - len(one.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (without the HTTP head) of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def store_of(path: str) -> tuple:
    """The file system of a path and the path in it; Hadoop's names of object stores are those of the stores."""
    from pyarrow import fs

    path = re.sub(r"^(s3)[an]://", r"\1://", path)
    return fs.FileSystem.from_uri(path if "://" in path else path if path.startswith("file:") else "file://" + path)


def _put(folder: str, name: str, data: bytes) -> str:
    """Write a file whole: to a name of its own first, then renamed, so that a retried task does no harm."""
    store, at = store_of(folder)
    store.create_dir(at, recursive=True)
    temporary = f"{at}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    store.move(temporary, f"{at}/{name}")
    return f"{folder}/{name}"


def _get(path: str) -> bytes:
    store, at = store_of(path)
    with store.open_input_stream(at, compression=None) as source:
        return source.read()


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload and refers_to (null for responses) of each row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole(html_col).cast("binary").alias("payload"))
    narrow = rows.select("page_id", F.sha1("payload").alias("sha1"), F.xxhash64("payload").alias("xxh"), F.octet_length("payload").alias("bytes"))
    narrow = materialize(narrow, "payload-digests")
    digests = ["sha1", "xxh", "bytes"]
    first = narrow.groupBy(*digests).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(*digests, "first")
    ids = narrow.join(first.hint("rebalance"), digests).where("page_id > first").select("page_id", "xxh", "bytes", F.col("first").alias("refers_to")).distinct()
    ids = materialize(ids.withColumnsRenamed({"page_id": "again", "xxh": "again_xxh", "bytes": "again_bytes"}), "revisits")
    probed = possibly(rows.withColumn("xxh", F.xxhash64("payload")), ids, "xxh", "again_xxh")
    straight = probed.where("NOT maybe").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    same = (F.col("page_id") == F.col("again")) & (F.col("xxh") == F.col("again_xxh")) & (F.octet_length("payload") == F.col("again_bytes"))
    found = probed.where("maybe").join(ids, same, "left").select("page_id", "url", "payload", "refers_to")
    return straight.unionByName(found)


def write_archives(resolved: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``resolve`` to archives in a shared folder; returns their paths and record counts.

    A task names its archives by its partition and its content, and lists those of its last attempt
    only: archives that a lost attempt left behind are on no list.
    """
    bounded_batches(resolved.sparkSession, 500)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = format_archive(held)
            path = _put(folder, f"pages-{hashlib.sha256(data).hexdigest()[:24]}.warc.zst", data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(format_record(page_id, url, payload, digest(payload), refers_to, refers_to is not None))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return materialize(resolved.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record of the archives (column path).

    Lengths and digests of responses are computed from the payloads read; those of revisits come from
    their headers. The list of archives is a table; each task opens those that are dealt to it.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    bounded_batches(archives.sparkSession, 500)

    def number(urn: str | None) -> int | None:
        return None if urn is None or urn.endswith(":none>") else int(urn.rpartition(":")[2][:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for record in iterate_archive(_get(path)):
                    head, payload = parse_record(record)
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response":
                        found = digest(payload)
                        if (found, len(payload)) != (told, int(head["X-Payload-Length"])):
                            raise ValueError(f"{head['WARC-Record-ID']} is damaged")
                    rows.append((number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), told, head["WARC-Type"], number(head.get("WARC-Refers-To"))))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    tasks = max(1, min(archives.count(), TASKS))
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives, read them back and describe each record.

    A null html is an empty payload; empty payloads are deduplicated like others. Rows with
    a null id are responses and never referred to; rows that repeat the smallest id are all responses. An empty table writes no archive. Other columns are not read.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(resolve(pages, id_col, url_col, html_col), folder))
