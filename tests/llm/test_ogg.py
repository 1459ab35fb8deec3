import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def page_starts(media):
    at, out = 0, []
    while at < len(media):
        out.append(at)
        n = media[at + 26]
        at += 27 + n + sum(media[at + 27 : at + 27 + n])
    return [*out, len(media)]


def test_checksum():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.page_checksum(data) == slow_checksum(data)


def test_packets_of_any_size_come_back():
    sizes = [0, 1, 254, 255, 256, 510, 65_025, 65_026, 200_000]
    packets, end = [], 0
    for n in sizes:
        end += n
        packets.append((bytes(n), end))
    stream = ogg.read_ogg(b"".join(page for _, page in ogg.paginate(7, packets)))[7]
    assert [len(p) for p in stream.packets] == sizes and stream.ends == [e for _, e in packets]


@pytest.mark.parametrize("size", [64, 4096, 8192, 8256, 64 * 4001])
def test_round_trip(size):
    data = random.Random(size).randbytes(size)
    streams = ogg.read_ogg(ogg.write_ogg(data))
    assert ogg.samples(streams) == data and len(streams) == ogg.STREAMS


def test_damage_is_found():
    media = ogg.write_ogg(random.Random(1).randbytes(40_960))
    starts = page_starts(media)
    for at in range(30, len(media), 997):
        with pytest.raises(ValueError):
            ogg.read_ogg(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    for a, b in zip(starts, starts[1:]):
        with pytest.raises(ValueError):
            ogg.read_ogg(media[:a] + media[b:])
    with pytest.raises(ValueError):
        ogg.read_ogg(media[:-1])


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (5, "long " * 40_000), (5, "long " * 40_000), (None, "x" * 65)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"media": F.lit("clash"), "n_bytes": F.lit(1)})
    got = ogg.read_features(ogg.store_documents(df)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got if r["doc_id"]) == [(False, d) for d in (1, 2, 3, 4, 5, 5)] and len(got) == len(rows)
    features = {}
    for r in got:
        data = ((next(t for d, t in rows if d == r["doc_id"])) or "").encode()
        payload = data + bytes(-len(data) % 64 or 64 * (not data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert features.setdefault(payload, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_empty_table(spark):
    assert ogg.read_features(ogg.store_documents(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
