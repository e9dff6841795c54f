"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent frames of whole records, a skippable frame with the bundle's index (record
identifier, frame, offset in the frame, length), and a seek table in the public seekable format, whose last four bytes
are its magic number. A file holds one bundle or several, one after another; any Zstandard tool decompresses it whole.

Files are written by Spark's own text writer, so they reach whatever file system the folder is in: a row is a bundle
without its last four bytes, and the line separator is those bytes. A file has a bounded number of bundles, and is read
back whole as a binary file; a single record is read from its frame alone, by its place in the index.

A record's identifier is <urn:page:N> for the only row of page N. Rows whose page_id is null or occurs again are
<urn:page:N:task.place>, so that each record has its own; what refers to such a page names <urn:page:N>.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import counted_join, slices, small_batches, written

#: Raw bytes of a frame and of a bundle, about, a record larger than either has its own; bundles of a file.
FRAME_BYTES, BUNDLE_BYTES, BUNDLES = 1 << 18, 1 << 23, 16
#: Fixed values of the formats.
SEEK_MAGIC = bytes([0xB1, 0xEA, 0x92, 0x8F])
SEEK_FRAME, INDEX_FRAME = 0x184D2A5E, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "record_id string, page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
INDEX = "record_id string, file string, frame_offset long, frame_bytes long, record_offset long, record_bytes long"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str, place: str = "") -> tuple[str, bytes]:
    """The identifier and the bytes of a record; a revisit has the HTTP head only. place: tells records of one page_id apart."""
    name = f"<urn:page:{'null' if page_id is None else page_id}{place and ':'}{place}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Gathers records into frames; close() gives the bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.frame_bytes, self.codec = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.held = self.raw = 0

    def add(self, name: str, data: bytes) -> None:
        if self.open and self.held + len(data) > self.frame_bytes:
            self.flush()
        self.index.append((name, len(self.frames), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)
        self.raw += len(data)

    def flush(self) -> None:
        if self.open:
            self.frames.append(self.codec.compress(b"".join(self.open)))
            self.sizes.append(self.held)
            self.open, self.held = [], 0

    def close(self) -> bytes:
        self.flush()
        index = self.codec.compress(json.dumps(self.index).encode())
        parts = [*self.frames, struct.pack("<II", INDEX_FRAME, len(index)) + index]
        sizes = [*zip(map(len, self.frames), self.sizes, strict=True), (len(parts[-1]), 0)]
        table = b"".join(struct.pack("<II", *x) for x in sizes)
        return b"".join(parts) + struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + struct.pack("<IB", len(sizes), 0) + SEEK_MAGIC


class SeekableReader:
    """Random access to a file of bundles: the seek tables and indexes are read from the end, then single frames."""

    def __init__(self, file) -> None:
        self.file, self.codec = file, zstandard.ZstdDecompressor()
        end = file.seek(0, 2)
        self.index: dict[str, tuple[int, int, int, int]] = {}
        self.entries: list[tuple[str, int, int, int, int]] = []
        while end:
            count, _, magic = struct.unpack("<IB4s", self.at(end - 9, 9))
            if magic != SEEK_MAGIC:
                raise ValueError("no seek table")
            table = self.at(end - 9 - 8 * count, 8 * count)
            sizes = [struct.unpack_from("<II", table, 8 * k) for k in range(count)]
            start = end - 17 - 8 * count - sum(x[0] for x in sizes)
            places = [start + sum(x[0] for x in sizes[:k]) for k in range(count)]
            rows = json.loads(self.codec.decompress(self.at(places[-1] + 8, sizes[-1][0] - 8)))
            self.entries[:0] = [(name, places[f], sizes[f][0], offset, length) for name, f, offset, length in rows]
            end = start
        self.index = {x[0]: x[1:] for x in self.entries}

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def read(self, name: str) -> bytes:
        """A record by its identifier: one frame is read and decompressed."""
        place, size, offset, length = self.index[name]
        return self.codec.decompress(self.at(place, size))[offset : offset + length]

    def records(self) -> Iterator[tuple[str, bytes]]:
        frame, raw = None, b""
        for name, place, size, offset, length in self.entries:
            if place != frame:
                frame, raw = place, self.codec.decompress(self.at(place, size))
            yield name, raw[offset : offset + length]


def parsed(data: bytes) -> tuple:
    """The columns of RECORDS; a response whose payload differs from its digest or length is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: None if x in (None, "null") else int(x)
    key = lambda x: x and x[len("<urn:page:") : -1].partition(":")[0]
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: its payload is not what its head says")
    return fields["WARC-Record-ID"], number(key(fields["WARC-Record-ID"])), fields["WARC-Target-URI"], fields["WARC-Type"], number(key(fields.get("WARC-Refers-To"))), size, digest, None if revisit else payload


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of pages (page_id, url, html) into files under folder.

    Of rows with equal payloads of `least` bytes or more, those with the largest page_id are responses and the others
    revisit it; null is the smallest page_id. So repeated rows of that page_id are each a response, as are rows of which
    all page_ids are null. A null html is an empty payload, a null url an empty one. Payloads of any length are
    whole; an empty table gives a folder without records; other columns play no part.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    count = F.count(F.lit(1)).alias("rows")
    same = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("newest"), count).where("rows > 1")
    again = rows.where("page_id is not null").groupBy("page_id").agg(count, F.lit(True).alias("again")).where("rows > 1")
    rows = counted_join(rows, written(same, "warc-same"), ["sha"], "rows", "left")
    rows = counted_join(rows, written(again, "warc-again"), ["page_id"], "rows", "left")
    schema = "bundle binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, task, place = BundleWriter(), TaskContext.get().partitionId(), 0
        for batch in (part for b in batches for part in slices(b, "payload")):
            for page_id, url, data, sha, newest, repeated in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "newest", "again")), strict=True):
                revisit = newest is not None and newest != page_id and len(data) >= least
                place += 1
                own = f"{task}.{place}" if page_id is None or repeated else ""
                out.add(*record(page_id, url, data, len(data), base64.b32encode(sha).decode(), newest, revisit, date, own))
                if out.raw >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([out.close()[:-4]], pa.binary())], names=["bundle"])
                    out = BundleWriter()
        if out.index:
            yield pa.RecordBatch.from_arrays([pa.array([out.close()[:-4]], pa.binary())], names=["bundle"])

    # the binary of each row goes through the writer as it is: a cast to string doesn't touch the bytes
    lines = rows.mapInArrow(run, schema).select(F.col("bundle").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", SEEK_MAGIC.decode("latin-1")).option("maxRecordsPerFile", BUNDLES).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("path", "content")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives under folder, as RECORDS has them; payload is null for revisits."""
    import io

    schema = spark.createDataFrame([], RECORDS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for _, data in SeekableReader(io.BytesIO(batch.column("content")[k].as_py())).records():
                    rows.append(parsed(data))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return _files(spark, folder).mapInArrow(run, schema)


def archive_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each record is: its file, its frame's place there, and its own place in the frame."""
    import io

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column("path")[k].as_py()
                if rows := SeekableReader(io.BytesIO(batch.column("content")[k].as_py())).entries:
                    name, *numbers = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([path] * len(name)), *(pa.array(x, pa.int64()) for x in numbers)], names=["record_id", "file", "frame_offset", "frame_bytes", "record_offset", "record_bytes"])

    return _files(spark, folder).mapInArrow(run, INDEX)


def record_at(spark: SparkSession, entry: Row) -> bytes:
    """A record by its row of archive_index: no more than its frame is read, from whatever file system the file is in."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(entry.file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(entry.frame_offset)
        frame = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(entry.frame_bytes)))
    finally:
        stream.close()
    raw = zstandard.ZstdDecompressor().decompress(frame)
    return raw[entry.record_offset : entry.record_offset + entry.record_bytes]
