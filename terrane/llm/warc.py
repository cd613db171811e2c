"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; the bundle ends in a skippable frame with the seek table (compressed and
uncompressed size of every frame), and an index maps record identifiers to frame, offset within the frame and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, saved, small_side, utf8

# Fixed values of the seekable format: magic of its skippable frame, magic of its footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Uncompressed bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
#: Payloads of fewer bytes are always stored in full.
REVISIT_BYTES = 1000
#: Digests with copies are broadcast up to this many rows (about 100 bytes each); beyond it the join shuffles.
BROADCAST_DIGESTS = 200_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "record_id string, frame int, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long, page_id long"


def record_id(page_id: int | None, url: str | None, digest: bytes) -> str:
    """The same for equal pages, whenever and wherever they are written, so a revisit can name the record it refers to."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest.hex()}:{zlib.crc32((url or '').encode('utf-8', 'surrogatepass')):08x}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: tuple[int, str | None] | None, full_bytes: int) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but its digest, its length and the record (page, url) it refers to."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % full_bytes
    if not revisit:
        body += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(c for c in url or 'about:blank' if c > ' ')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(*refers_to, digest)}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at this offset."""
    data = bytes(data) if not isinstance(data, bytes) else data
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at offset {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at offset {at} is not closed")
    return headers, data[start:stop], stop + 4


class BundleWriter:
    """Collects records into frames; at most one frame and one bundle are in memory."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame, self.size, self.done, self.table = [], 0, bytearray(), []

    def add(self, record: bytes) -> None:
        self.frame.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.frame:
            packed = self.compressor.compress(b"".join(self.frame))
            self.done += packed
            self.table.append((len(packed), self.size))
            self.frame, self.size = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        return bytes(self.done) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, uncompressed size) of every frame, read from the end of the bundle."""
    count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if descriptor & 0x80 else 8
    start = len(bundle) - 9 - count * entry
    if struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE_MAGIC, count * entry + 9):
        raise ValueError("the seek table is not in a skippable frame")
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack("<II", bundle[start + i * entry : start + i * entry + 8])
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, packed, plain = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Random access: only the frame that holds the record is decompressed."""
    headers, block, _ = parse_record(read_frame(bundle, frame), offset)
    return headers, block


def index_rows(bundle: bytes) -> Iterator[tuple]:
    """One row per record of the bundle, everything read from the stored bytes; stored payloads are checked."""
    unpack = zstandard.ZstdDecompressor()
    for frame, (start, packed, plain) in enumerate(seek_table(bundle)):
        data, at = unpack.decompress(bundle[start : start + packed], max_output_size=plain), 0
        while at < len(data):
            headers, block, end = parse_record(data, at)
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rsplit(b"Content-Length: ", 1)[1])
            digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"{headers['WARC-Record-ID']}: stored payload differs from its digest")
            ident = headers["WARC-Record-ID"][1:-1].split(":")[2]
            yield headers["WARC-Record-ID"], frame, at, end - at, size, digest, kind, int(refers[1:-1].split(":")[2]) if refers else None, None if ident == "null" else int(ident)
            at = end


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number, writer = TaskContext.get().partitionId(), 0, BundleWriter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([f"{task:08d}-{number:06d}"]), pa.array([writer.finish()], pa.binary())], ["bundle_id", "bundle"])

    for batch in batches:
        for page, url, payload, digest, refers, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            writer.add(record_bytes(page, url, payload or b"", digest, None if refers is None else (refers, at), size))
            if len(writer.done) >= BUNDLE_BYTES:
                yield out()
                number, writer = number + 1, BundleWriter()
    if writer.done or writer.frame:
        yield out()


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    types = [kinds[x.split()[1]] for x in INDEX_SCHEMA.split(", ")]
    for batch in batches:
        for name, bundle in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            columns = list(zip(*index_rows(bundle.as_py()), strict=True))
            yield pa.record_batch([pa.array([name] * len(columns[0])), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["bundle_id", *names])


def write_bundles(pages: DataFrame) -> DataFrame:
    """Table (bundle_id, bundle) of the archives, written to the shared folder by Spark's own writer.

    Bundles are binary rows, so any store that Spark can write holds them; each is a whole seekable file. Null html is an
    empty payload and very long html one record; null ids and repeated rows give a record each; other columns are
    ignored, whatever their names; no pages, no records.
    """
    bounded_arrow(pages.sparkSession)
    html = F.coalesce(utf8(F.col("html")), F.lit(b""))
    rows = pages.select(F.col("page_id"), F.col("url"), html.alias("payload"), F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    copies = rows.where(f"size >= {REVISIT_BYTES}").groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("last")).where("n > 1 and last.page_id is not null")
    copies = saved(copies.select("digest", F.col("last.page_id").alias("last"), F.col("last.url").alias("last_url")), "digests")
    joined = rows.join(small_side(copies, copies.count(), BROADCAST_DIGESTS), "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    revisit = revisit & (F.col("size") >= REVISIT_BYTES)
    out = joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", F.when(revisit, F.col("last")).alias("refers_to"), F.col("last_url").alias("refers_url"), "size")
    return saved(out.mapInArrow(_write, "bundle_id string, bundle binary"), "bundles", "uncompressed")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """The index of all records, read back from the stored archives, a row for each; no bundles, no rows."""
    bounded_arrow(bundles.sparkSession, 4)
    return bundles.mapInArrow(_read, f"bundle_id string, {INDEX_SCHEMA}")


def warc_table(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per row of pages, read back from the archives.

    Null html is an empty payload. Of equal payloads of at least 1000 bytes every row with the largest page_id is a
    response, the others revisit it; null page_ids count as smallest, and where all are null each is a response.
    Repeated rows get a record each, under one identifier as their records are equal. Null urls become about:blank; a
    very long payload is a frame of its own; other columns are ignored, whatever their names. No pages, no rows.
    """
    return read_bundles(write_bundles(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
