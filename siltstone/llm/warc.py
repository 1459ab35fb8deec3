"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header of every record is kept
in a table of its own. Reading back recomputes the digests from the stored bytes, and joins
headers to payloads to rebuild records byte for byte.

Rows of the payload and header tables meet in joins between two scans, whose hot digests
Spark can split; which copy is kept comes from a partially aggregated minimum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.llm.shared import materialise, require

#: Digits of base 32 as Java writes them, and as RFC 4648 does (fixed values).
JAVA32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What the archive writes in every record (fixed values).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: eight groups of five hexadecimal digits, four letters each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), JAVA32, RFC32)


@dataclass
class Archive:
    """payloads: digest, first_id, payload (once each); headers: page_id, digest of the full payload and the exact header of each record."""

    payloads: DataFrame
    headers: DataFrame


def write_archive(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Write one record per row of ``pages``.

    Of records with equal payloads of at least ``least`` bytes, that with the smallest id is
    the ``response`` and the others are ``revisit`` records that refer to it; records with
    smaller payloads are all responses. A null payload is empty. Rows that share the smallest
    id and the payload are all responses; a null id counts as larger than any other, and
    revisits of a group without any id refer to null. Extra columns are ignored.
    """
    require(pages, [id_col, url_col, payload_col])
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    index = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    index = materialise(index, "warc-index")
    kept = index.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    kept = kept.select(F.xxhash64("first_id", "digest").alias("place"), "digest")
    held = rows.select(F.xxhash64("page_id", "digest").alias("place"), "digest", "page_id", "payload").join(kept, ["place", "digest"], "left_semi")
    # the join has dealt rows by both columns, so that dropping repeated rows moves nothing
    payloads = materialise(held.dropDuplicates(["place", "digest"]).select("digest", F.col("page_id").alias("first_id"), "payload"), "warc-payloads")
    marked = index.join(payloads.select("digest", "first_id"), "digest")
    revisit = (F.col("n_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    headers = marked.select("page_id", "digest", header(revisit).alias("header"))
    return Archive(payloads, materialise(headers, "warc-headers"))


def record_id(of: Column) -> Column:
    """A stable URN from the id of the row."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(of.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] * bool(k) + [F.substring(h, a, n)])), F.lit(">"))


def header(revisit: Column) -> Column:
    """The exact header bytes of a record, with the empty line that ends them."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    url = F.regexp_replace("url", r"[\r\n]", " ")
    return F.encode(F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", record_id(F.col("page_id"))), line("WARC-Date", F.lit(DATE)), optional("WARC-Target-URI", url), F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("first_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("Content-Type", F.lit("application/octet-stream")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))), F.lit("\r\n")), "UTF-8")


def verified(archive: Archive) -> DataFrame:
    """The payloads with digests and sizes of the stored bytes; a stored digest that differs fails the job."""
    again = F.sha2("payload", 256)
    return archive.payloads.select(F.when(again == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("stored bytes differ from their digest "), F.col("digest")))).alias("digest"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def records(archive: Archive) -> DataFrame:
    """Headers joined to the payloads read back, and what the header bytes say: record_type, record_id, refers (a record id).

    A header whose payload digest or length is not that of the stored bytes fails the job.
    """
    field = lambda name: F.regexp_extract("_head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    read = archive.headers.withColumn("_head", F.decode("header", "UTF-8")).select("page_id", "digest", "header", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers"), field("WARC-Payload-Digest").alias("said"), field("Content-Length").try_cast("long").alias("length"))
    both = read.join(verified(archive), "digest")
    right = (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("length") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))) & F.col("record_type").isin("response", "revisit")
    checked = F.when(right, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("a header differs from its payload: "), F.col("record_id"))))
    return both.withColumn("record_type", checked).drop("said", "length")


def read_archive(archive: Archive) -> DataFrame:
    """One row a record, from headers and payloads as read back; ``refers_to`` is the page of the record that a revisit names."""
    read = materialise(records(archive).drop("payload", "header", "digest"), "warc-read")
    named = read.groupBy("record_id").agg(F.min("page_id").alias("refers_to")).withColumnRenamed("record_id", "refers")
    return read.join(named, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def reconstruct_records(archive: Archive) -> DataFrame:
    """Every record's bytes as in a WARC file, and the full payload also for revisits."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records(archive).select("page_id", "record_type", F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def write_files(archive: Archive, path: str) -> None:
    """Write the headers and payload tables under a folder that Spark can reach."""
    archive.payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    archive.headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def open_files(spark: SparkSession, path: str) -> Archive:
    return Archive(spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/headers"))
