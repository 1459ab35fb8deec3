import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import warc

ROWS = [(5, "http://a/", "<p>x</p>"), (3, "http://b/", "<p>x</p>"), (3, "http://b/", "<p>x</p>"), (9, None, None), (8, "u\r\nX: y", ""), (None, "n", "<p>x</p>"), (7, "é", "é" * 5000), (6, "long", "z" * 300_000)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "payload": F.lit(1)})


def test_records(spark):
    got = sorted((tuple(r) for r in warc.read_archive(warc.write_archive(table(spark))).collect()), key=repr)
    first, want = {"<p>x</p>": 3, "": 8}, []
    for page, _, html in ROWS:
        data = (html or "").encode()
        low = first.get(html or "", page)
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == low else "revisit", None if page == low else low))
    assert got == sorted(want, key=repr)


def test_small_payloads_are_all_responses(spark):
    got = warc.read_archive(warc.write_archive(table(spark), least=100)).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_records_are_rebuilt_and_payloads_stored_once(spark, tmp_path):
    archive = warc.write_archive(table(spark))
    warc.write_files(archive, str(tmp_path))
    archive = warc.open_files(spark, str(tmp_path))
    assert archive.payloads.count() == 4
    for r in warc.reconstruct_records(archive).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and fields["WARC-Type"] == r["record_type"] and body.endswith(b"\r\n\r\n")
        assert len(body) - 4 == int(fields["Content-Length"])
        assert body[:-4] == (b"" if r["record_type"] == "revisit" else bytes(r["payload"]))
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()


@pytest.mark.parametrize("wrong", ["WARC-Type: response", "sha1:", "Content-Length: 8"])
def test_a_damaged_header_is_noticed(spark, wrong):
    archive = warc.write_archive(table(spark))
    damaged = F.encode(F.replace(F.decode("header", "UTF-8"), F.lit(wrong), F.lit(wrong[:-1] + "x")), "UTF-8")
    with pytest.raises(Exception, match="a header differs"):
        warc.read_archive(warc.Archive(archive.payloads, archive.headers.withColumn("header", damaged))).collect()


def test_empty_table(spark):
    assert warc.read_archive(warc.write_archive(table(spark, []))).count() == 0
