"""WARC archives of individually compressed records with a Zstandard dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, new_path, read, staged

#: The magic number of a skippable frame that holds a dictionary (.warc.zst), and that of a dictionary and a frame.
DICTIONARY_FRAME = 0x184D2A5D
#: The first records of an archive, up to so many bytes, make its dictionary of at most so many bytes.
SAMPLE_BYTES = 2_000_000
DICTIONARY_BYTES = 48_000
#: Compressed bytes at which an archive ends and a task begins another.
ARCHIVE_BYTES = 16_000_000
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record that leaves the payload out. Both keep the payload's length in the HTTP head."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = (url or "").encode("ascii", "backslashreplace").decode().replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page_id, payload bytes, digest, type, refers to, payload found) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda s: int(x) if (x := s[len("<urn:page:") : -1]) else None
    return number(fields["WARC-Record-ID"]), length, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, payload


class Archive:
    """One archive, written in memory: a dictionary of its first records, then a frame for each record."""

    def __init__(self, dictionary_bytes: int = DICTIONARY_BYTES) -> None:
        self.waiting: list[bytes] = []
        self.waiting_bytes, self.size, self.records = 0, 0, 0
        self.parts: list[bytes] = []
        self.packer: zstandard.ZstdCompressor | None = None
        self.dictionary_bytes = dictionary_bytes

    def _begin(self) -> None:
        try:
            made = zstandard.train_dictionary(self.dictionary_bytes, self.waiting, level=LEVEL)
            data = made.as_bytes()
        except (zstandard.ZstdError, ValueError, MemoryError):  # too few records to train on: the last of them, plain, are the dictionary
            data = b"".join(self.waiting)[-self.dictionary_bytes :]
            made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
        self.parts.append(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self.size += len(self.parts[0])
        for w in self.waiting:
            self._put(w)
        self.waiting, self.waiting_bytes = [], 0

    def _put(self, data: bytes) -> None:
        self.parts.append(self.packer.compress(data))
        self.size += len(self.parts[-1])

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.packer is None:
            self.waiting.append(data)
            self.waiting_bytes += len(data)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(data)

    def close(self) -> bytes:
        if self.packer is None:
            self._begin()
        return b"".join(self.parts)


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        one = reader.decompressobj()
        out = [one.decompress(view[at : at + 65_536])]
        at += 65_536
        while not one.eof:
            out.append(one.decompress(view[at : at + 65_536]))
            at += 65_536
        at = min(at, len(data)) - len(one.unused_data)
        yield b"".join(out)


def deduplicated(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with __payload (binary), __digest and __refers_to.

    Of rows with equal payloads (by SHA-256) the one with the largest page_id is the response; the others refer to it.
    Null html is an empty payload. Rows without page_id count as smaller than any; of repeated rows of the largest page_id
    all are responses. Other columns are left out; an empty table stays empty.

    Digests are counted first, and only those that occur more than once meet the payloads: as a counted broadcast, or in
    a join whose hot digests Spark splits.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    pages = pages.select("page_id", "url", payload.alias("__payload"))
    sha256 = F.sha2("__payload", 256)
    last = pages.groupBy(sha256.alias("__of")).agg(F.max("page_id").alias("__last"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    last = staged(last, "warc-repeats")
    pages = pages.join(checked_broadcast(last, last.count()), sha256 == F.col("__of"), "left").drop("__of").withColumn("__sha1", F.sha1("__payload"))
    return pages.withColumn("__refers_to", F.when(F.col("__last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__last")), F.col("__last")))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page to archives in folder and return (path, records, bytes) of those written.

    Each task streams its rows into archives of about ``archive_bytes``. File names are new for each attempt, and only
    files in the returned table belong to the result, so a task that is run again does no harm.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def put(archive: Archive) -> pa.RecordBatch:
            name, data = f"pages-{uuid.uuid4().hex}.warc.zst", archive.close()
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": archive.records, "bytes": len(data)}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        archive = Archive()
        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                archive.add(record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to))
                if archive.size >= archive_bytes:
                    yield put(archive)
                    archive = Archive()
        if archive.records:
            yield put(archive)

    rows = deduplicated(pages).select("page_id", "url", "__payload", "__sha1", "__refers_to")
    return staged(rows.mapInArrow(written, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records in the archives of (path).

    The digest of a response is that of the payload that is found; it must be the one in the header.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = pafs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    data = f.read()
                rows = []
                for one in records_of(data):
                    page_id, size, sha1, kind, refers_to, payload = parsed(one)
                    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
                        raise ValueError(f"{path}: the payload of page {page_id} is not the one written")
                    rows.append((page_id, size, sha1, kind, refers_to))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    paths = manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)), "path")  # an archive is the unit of work
    return paths.mapInArrow(found, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(read(spark, sf_dir, "pages"), new_path(spark, "warc")))


