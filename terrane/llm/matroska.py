"""Matroska files: a writer for one audio track of 8-bit samples, and a parser into packet tables.

The parser reads variable-length EBML elements, clusters, SimpleBlocks and BlockGroups with Xiph, EBML and fixed
lacing, and cues, and gives each packet's track, timestamp and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, saved, utf8

# Fixed values of the format: element identifiers.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, VOID, CRC = 0x4282, 0x4287, 0x4285, 0xEC, 0xBF
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset({EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS})
#: Samples are one byte at 8000 per second; payloads are padded to whole units of 192 samples, 24 ms.
RATE, UNIT = 8000, 192
#: Units per packet, packets per block, blocks per cluster.
PACKET_UNITS, LACED, BLOCKS = 8, 8, 8


def element_id(ident: int) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all-ones data bits stay reserved for an unknown size."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Value (None: unknown size) and the offset behind it."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError("data ends within an integer")
    if keep_marker:
        return raw, at + width
    value = raw & ((1 << 7 * width) - 1)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def element(ident: int, body: bytes) -> bytes:
    return element_id(ident) + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(packets: list[bytes], mode: int) -> bytes:
    """Body of a block behind its flags; modes: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if mode == 0:
        return packets[0]
    head = bytes([len(packets) - 1])
    sizes = [len(p) for p in packets]
    if mode == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif mode == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
            head += vint(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(packets)


def unlace(data: bytes, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """(offset, length) of each packet of a block body."""
    if mode == 0:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if mode == 2:
        sizes = [(end - at) // count] * (count - 1)
    elif mode == 1:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif count > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            before = at
            delta, at = read_vint(data, at)
            width = at - before
            # an all-ones difference is the largest one, not an unknown size
            delta = (1 << 7 * width) - 1 if delta is None else delta
            sizes.append(sizes[-1] + delta - ((1 << (7 * width - 1)) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing exceeds its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


HEADER = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds the payload as 8-bit PCM; the same payload gives the same bytes."""
    step = UNIT * PACKET_UNITS
    packets = [payload[i : i + step] for i in range(0, len(payload), step)]
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, step * 10**9 // RATE) + audio))
    duration = element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"terrane") + element(WRITING_APP, b"terrane") + duration)
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    per_cluster = LACED * BLOCKS
    for c in range(0, len(packets), per_cluster):
        began = c * step * 1000 // RATE
        parts = [uint(CLUSTER_TIME, began)]
        for b in range(c, min(c + per_cluster, len(packets)), LACED):
            group = packets[b : b + LACED]
            mode = 0 if len(group) == 1 else 2 if len({*map(len, group)}) == 1 else 3
            parts.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", b * step * 1000 // RATE - began, 0x80 | mode << 1) + lace(group, mode)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, began) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return HEADER + element(SEGMENT, b"".join(body))


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, start, body start, body end) of the elements of a range; an unknown size reaches its end."""
    while at < end:
        start = at
        ident, at = read_vint(data, at, keep_marker=True)
        size, at = read_vint(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise ValueError(f"element {ident:x} exceeds its parent")
        yield ident, start, at, stop
        at = stop


def demux(data: bytes) -> dict:
    """Packets (track, timestamp in ms, cluster, offset, length), tracks, cues and clusters of a file."""
    out: dict = {"packets": [], "tracks": {}, "cues": [], "clusters": [], "duration": 0.0, "doc_type": ""}
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
    scale, steps = 1_000_000, {}

    def block(a: int, b: int, began: int) -> None:
        track, a = read_vint(data, a)
        delta, flags = struct.unpack(">hB", data[a : a + 3])
        for i, (at, n) in enumerate(unlace(data, a + 3, b, flags >> 1 & 3)):
            out["packets"].append((track, (began + delta) * scale // 10**6 + i * steps.get(track, 0) // 10**6, len(out["clusters"]) - 1, at, n))

    for ident, _, a, b in elements(data, 0, len(data)):
        if ident == EBML:
            out["doc_type"] = next((data[c:d].decode() for i, _, c, d in elements(data, a, b) if i == DOC_TYPE), "")
        if ident != SEGMENT:
            continue
        for kid, start, c, d in elements(data, a, b):
            if kid == INFO:
                for i, _, e, f in elements(data, c, d):
                    if i == TIMESTAMP_SCALE:
                        scale = number(e, f)
                    elif i == DURATION:
                        out["duration"] = real(e, f)
            elif kid == TRACKS:
                for _, _, e, f in elements(data, c, d):
                    track = {i: (g, h) for i, _, g, h in elements(data, e, f)}
                    n = number(*track[TRACK_NUMBER])
                    steps[n] = number(*track[DEFAULT_DURATION]) if DEFAULT_DURATION in track else 0
                    out["tracks"][n] = {"codec": data[slice(*track[CODEC_ID])].decode(), "type": number(*track[TRACK_TYPE])}
            elif kid == CLUSTER:
                out["clusters"].append((start - a, d - start))
                began = 0
                for i, _, e, f in elements(data, c, d):
                    if i == CLUSTER_TIME:
                        began = number(e, f)
                    elif i == SIMPLE_BLOCK:
                        block(e, f, began)
                    elif i == BLOCK_GROUP:
                        for j, _, g, h in elements(data, e, f):
                            if j == BLOCK:
                                block(g, h, began)
            elif kid == CUES:
                for _, _, e, f in elements(data, c, d):
                    point = {i: (g, h) for i, _, g, h in elements(data, e, f)}
                    for i, _, g, h in elements(data, *point[CUE_POSITIONS]):
                        if i == CUE_CLUSTER:
                            out["cues"].append((number(*point[CUE_TIME]), number(g, h)))
    return out


def padded(text: bytes) -> bytes:
    """The payload: the bytes, then spaces up to a positive multiple of the unit."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def feature(found: dict) -> str:
    sizes = [p[4] for p in found["packets"]]
    seekable = {c for _, c in found["cues"]} == {c for c, _ in found["clusters"]}
    codecs = ",".join(t["codec"] for _, t in sorted(found["tracks"].items()))
    return f"codec={codecs};packets={len(sizes)};clusters={len(found['clusters'])};cues={len(found['cues'])};seekable={int(seekable)};last_ms={found['packets'][-1][1]};duration_ms={found['duration']:.0f};bytes={sum(sizes)}"


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        for i in range(0, len(texts), 64):
            part = texts[i : i + 64]
            yield pa.record_batch([batch.column(0).slice(i, len(part)), pa.array([len(x) for x in part], pa.int64()), pa.array([mux(padded(x)) for x in part], pa.binary())], ["doc_id", "n_bytes", "media"])


READ_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for value in batch.column(2):
            data = value.as_py()
            found = demux(data)
            payload = b"".join(data[at : at + n] for _, _, _, at, n in found["packets"])
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(found))
            for c, x in zip(columns, row, strict=True):
                c.append(x)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)


PACKET_SCHEMA = "doc_id long, packet int, track long, timestamp_ms long, cluster int, offset long, length long"


def _packets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PACKET_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        for doc, value in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            rows = [(doc, i, *p) for i, p in enumerate(demux(value.as_py())["packets"])]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def store_media(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Table (doc_id, n_bytes, media) with one Matroska file per row of docs, in the shared folder.

    A null text is stored as an empty one; a very long text is one file like any other; null ids and repeated rows keep
    a file each; other columns are ignored, whatever their names; no documents, no rows.
    """
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), utf8(F.col(text)).alias("text"))
    return saved(rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media", "zstd")


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet: track, timestamp, cluster and byte range within the stored file.

    Each row of media is parsed whole and gives its own packets, so repeated rows repeat theirs and a null id stays null;
    no media, no rows.
    """
    bounded_arrow(media.sparkSession)
    return media.mapInArrow(_packets, PACKET_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of each stored file, computed from what the parser reads back.

    A null text is stored as an empty one; an empty text as one unit of spaces; equal texts give equal values; null
    ids and repeated rows keep a row each; a very long text is read whole; no documents, no rows.
    """
    bounded_arrow(media.sparkSession)
    return media.mapInArrow(_features, READ_SCHEMA)
