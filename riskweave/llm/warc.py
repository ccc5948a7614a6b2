"""WARC bundles in the seekable Zstandard format.

Records are grouped into frames that decompress on their own; a bundle is a run of frames and, as its footer, the seek
table of the seekable format: a skippable frame with the compressed and full size of each frame, their number and the
magic number.  The index maps a record's identifier to its bundle, the frame's number and the offset in the frame, so
one record costs one frame's decompression.  Bundles are rows (bundle, data) of a Parquet table in the shared folder:
Spark commits them, so a lost task leaves no half bundle, and any store will do.

Rows: null html is an empty payload; null url and page_id are allowed.  Of pages with equal payloads of at least
MIN_REVISIT bytes the one with the largest page_id is written whole, the others as revisits without payload; rows that
tie for the largest page_id are all written whole.  Record identifiers hold the place where a row was written, so rows
alike have their own.  Reading checks each whole payload against its length and digest.  An empty table gives no bundles.  Payloads of any length are whole.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import cut

MIN_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLES = "bundle string, data binary, records array<struct<record_id:string,page_id:bigint,frame:int,offset:int,length:int>>"
_BUNDLES = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("records", pa.list_(pa.struct([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))])
PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _record(page_id, url, payload: bytes, size: int, digest: str, refers_to, revisit: bool, place: str = "") -> tuple[str, bytes]:
    """place tells apart the records of rows that are alike."""
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{place}')}>"
    block = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""]).encode() + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return record_id, "\r\n".join(head).encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames; close() gives the bundle's bytes and its index."""

    def __init__(self, level: int = 3):
        self._zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._out, self._frames, self._open, self._open_bytes, self._index = io.BytesIO(), [], [], 0, []

    @property
    def size(self) -> int:
        return self._out.tell() + self._open_bytes // 3

    def add(self, record_id: str, page_id, data: bytes) -> None:
        if self._open_bytes and self._open_bytes + len(data) > FRAME_BYTES:
            self._end_frame()
        self._index.append({"record_id": record_id, "page_id": page_id, "frame": len(self._frames), "offset": self._open_bytes, "length": len(data)})
        self._open.append(data)
        self._open_bytes += len(data)

    def _end_frame(self) -> None:
        packed = self._zstd.compress(b"".join(self._open))
        self._out.write(packed)
        self._frames.append((len(packed), self._open_bytes))
        self._open, self._open_bytes = [], 0

    def close(self) -> tuple[bytes, list[dict]]:
        if self._open:
            self._end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self._frames) + struct.pack("<IBI", len(self._frames), 0, SEEKABLE_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        return self._out.getvalue(), self._index


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Of a bundle: offset, compressed and full size of each frame."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    step = 12 if flags & 0x80 else 8
    at, out = 0, []
    for k in range(n):
        packed, full = struct.unpack_from("<II", data, len(data) - 9 - (n - k) * step)
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[frame[0]: frame[0] + frame[1]], max_output_size=frame[2])


def read_record(data: bytes, frame: int, offset: int, length: int) -> dict:
    """One record by its place, from one frame."""
    return next(_records(read_frame(data, seek_table(data)[frame])[offset: offset + length]))


def _records(block: bytes) -> Iterator[dict]:
    at = 0
    while at < len(block):
        end = block.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in block[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        url = head.get("WARC-Target-URI")
        number = lambda k: int(head[k]) if k in head and head[k] != "None" else None
        body = block[block.index(b"\r\n\r\n", end + 4) + 4: end + 4 + size]
        length, digest = number("X-Payload-Length"), head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(body), hashlib.sha1(body).hexdigest()) != (length, digest):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} is not what its digest says")
        yield {
            "page_id": number("X-Page-ID"), "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "payload_bytes": length, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": body,
        }
        at = end + 4 + size + 4


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def ended(w: BundleWriter) -> pa.RecordBatch:
        data, index = w.close()
        return pa.RecordBatch.from_pylist([{"bundle": uuid.uuid5(uuid.NAMESPACE_OID, "".join(x["record_id"] for x in index)).hex, "data": data, "records": index}], _BUNDLES)

    w, n, task = None, 0, TaskContext.get()
    part = task.partitionId() if task else 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for x in batch.slice(at, 256).to_pylist():
                w = w or BundleWriter()
                payload = b"" if x["revisit"] else x["payload"]
                record_id, data = _record(x["page_id"], x["url"], payload, x["size"], x["digest"], x["refers_to"], x["revisit"], f"{part}:{n}")
                n += 1
                w.add(record_id, x["page_id"], data)
                if w.size >= BUNDLE_BYTES:
                    yield ended(w)
                    w = None
    if w:
        yield ended(w)


def bundle(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> bundles with their index, not yet written."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    first = (
        rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "first")
    )
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size",
                       F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")).mapInArrow(_write, BUNDLES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            data = data.as_py()
            for frame in seek_table(data):
                yield pa.RecordBatch.from_pylist(list(_records(read_frame(data, frame))), _PAGES)


def read(bundles: DataFrame) -> DataFrame:
    """Bundles -> a row for each record, with the payload that it holds."""
    return bundles.select("data").mapInArrow(_read, PAGES)


def index(bundles: DataFrame) -> DataFrame:
    """Bundles -> record_id, page_id, bundle, frame, offset, length."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.*", "bundle")


def archive(pages: DataFrame) -> DataFrame:
    """Write the bundles to the shared folder; the table that was written."""
    return cut(bundle(pages))
