"""Media columns: documents as 8-bit samples in Ogg.

Writing: the payload is cut into packets, dealt in turn to two logical streams, laced into
pages and multiplexed by time. Reading: page checksums and sequence numbers are verified,
logical streams told apart by serial number, packets reassembled from lacing values over
page borders, and times derived from granule positions. Each row is handled alone (one
narrow pass a direction); the stored form is a binary column of a table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.shared import materialise, require, text_or_empty

#: Samples a second, samples a packet, and logical streams of the stored form.
RATE, PACKET, STREAMS = 8000, 4096, 2
UNIT = 64
#: Page header: magic, version, flags, granule, serial, sequence, checksum, segments (a fixed format).
HEAD = struct.Struct("<4sBBqIIIB")
MAGIC, CODEC = b"OggS", b"\x01PCM8"
CONTINUED, FIRST, LAST = 1, 2, 4
SEGMENTS = 255
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, unreflected, from 0: zlib's CRC of mirrored bytes, mirrored."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or UNIT * (not data))


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one stream as (granule for the order, bytes); packets come with their last granule."""
    pages: list[tuple[int, bytes]] = []
    table, body, granule, flags = bytearray(), bytearray(), -1, 0

    def flush(last: bool) -> None:
        nonlocal table, body, granule
        kind = flags | FIRST * (not pages) | LAST * last
        head = HEAD.pack(MAGIC, 0, kind, granule, serial, len(pages), 0, len(table))
        page = head + bytes(table) + bytes(body)
        page = page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]
        pages.append((granule if granule >= 0 else pages[-1][0] + 1 if pages else 0, page))
        table, body, granule = bytearray(), bytearray(), -1

    for k, (packet, end) in enumerate(packets):
        laces, at = lacing(len(packet)), 0
        while laces:
            room = SEGMENTS - len(table)
            part, laces = laces[:room], laces[room:]
            size = sum(part)
            table += part
            body += packet[at : at + size]
            at += size
            if not laces:
                granule = end
            if laces or len(table) == SEGMENTS or k == 0 or k == len(packets) - 1:
                flush(k == len(packets) - 1 and not laces)
                flags = CONTINUED if laces else 0
    return pages


def write_ogg(payload: bytes) -> bytes:
    """The payload as a physical stream of two logical ones; equal payloads give equal bytes."""
    serial = zlib.crc32(payload) & 0x7FFFFFFF
    pages: list[tuple[int, int, bytes]] = []
    for s in range(STREAMS):
        packets, end = [(CODEC + struct.pack("<IBB", RATE, s, STREAMS), 0)], 0
        for a in range(s * PACKET, len(payload), STREAMS * PACKET):
            block = payload[a : a + PACKET]
            end += len(block)
            packets.append((block, end))
        pages += [(0 if not k else max(1, g), s, page) for k, (g, page) in enumerate(paginate(serial | s << 31, packets))]
    pages.sort(key=lambda p: p[:2])  # stable: all first pages come first, then by time
    return b"".join(p[2] for p in pages)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    partial: bytearray = field(default_factory=bytearray)
    open: bool = False
    pages: int = 0
    ended: bool = False

    @property
    def starts(self) -> list[int]:
        return [e - len(p) for p, e in zip(self.packets[1:], self.ends[1:])]


def read_ogg(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. ValueError on a bad checksum, gap, or torn packet."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise ValueError("a page header is cut off")
        magic, version, flags, granule, serial, sequence, checksum, n = HEAD.unpack_from(media, at)
        if magic != MAGIC or version:
            raise ValueError("no page where one should start")
        laces = media[at + HEAD.size : at + HEAD.size + n]
        body = at + HEAD.size + n
        end = body + sum(laces)
        if len(laces) < n or end > len(media):
            raise ValueError("a page is cut off")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != checksum:
            raise ValueError("a page fails its checksum")
        if flags & FIRST:
            if serial in streams:
                raise ValueError("a stream begins twice")
            streams[serial] = Stream()
        if serial not in streams or streams[serial].pages != sequence or streams[serial].ended:
            raise ValueError("a page is missing or out of order")
        s = streams[serial]
        if s.open != bool(flags & CONTINUED):
            raise ValueError("a packet is torn")
        s.pages, s.ended, first = s.pages + 1, bool(flags & LAST), len(s.packets)
        for lace in laces:
            s.partial += view[body : body + lace]
            body += lace
            s.open = lace == 255
            if not s.open:
                s.packets.append(bytes(s.partial))
                s.partial.clear()
        if len(s.packets) > first:  # the page's granule is that of the last packet it ends
            ends, back = [], granule
            for p in reversed(s.packets[first:]):
                ends.append(back)
                back -= len(p)
            s.ends += reversed(ends)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def samples(streams: dict[int, Stream]) -> bytes:
    """The streams' packets merged by start time, then stream."""
    parts = sorted((start, serial >> 31, p) for serial, s in streams.items() for start, p in zip(s.starts, s.packets[1:]))
    return b"".join(p[2] for p in parts)


def describe(streams: dict[int, Stream], data: bytes) -> str:
    """Features of what was read back: structure, times and levels."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    signs = np.flatnonzero(np.diff(x >= 128)).size
    last = max((s.ends[-1] for s in streams.values() if s.ends), default=0)
    return f"streams={len(streams)} pages={sum(s.pages for s in streams.values())} packets={sum(len(s.packets) for s in streams.values())} last_ms={last * 1000 // RATE} ms={len(x) * 1000 // RATE} mean={int(x.sum()) * 1000 // len(x)} energy={int((x * x).sum()) // len(x)} crossings={signs}"


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of id, ``n_bytes`` and ``media``, written to the shared folder.

    A null text counts as empty (64 bytes 0); repeated rows are stored each; an empty table
    gives an empty one; extra columns are ignored.
    """
    require(docs, [id_col, text_col])
    rows = docs.select(F.col(id_col), F.encode(text_or_empty(text_col), "UTF-8").alias("data"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1000):
                batch = whole.slice(a, 1000)
                data = batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([write_ogg(padded(bytes(d))) for d in data], pa.binary())], names=[id_col, "n_bytes", "media"])

    return materialise(rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary"), "ogg-media")


def read_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read stored media back: payload digests, digest of the stored form, and features."""
    kind = media.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for m in batch.column(2):
                stored = m.as_py()
                streams = read_ogg(stored)
                data = samples(streams)
                found.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(streams, data)))
            n, sha, tail, size, stored_sha, feature = zip(*found) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), pa.array(size, pa.int64()), pa.array(stored_sha, pa.string()), pa.array(feature, pa.string())], names=[x.split(" ")[0].strip("`") for x in schema.split(", ")])

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, schema)
