"""Readers of file formats and landing folders, and sinks, all through Spark's own sources."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.operators.extract import acceptance_criteria

#: Parts of office files that hold text, by ending (fixed values).
OFFICE = {"docx": r"word/document\.xml", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml", "pptx": r"ppt/slides/slide\d+\.xml"}


def texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of whole text files, sub-folders too."""
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return r.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def binaries(spark: SparkSession, folder: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return b.orderBy("path").limit(most) if most is not None else b


def office_texts(files: DataFrame) -> DataFrame:
    """(path, text) of docx, xlsx and pptx files (path, content): the text runs of their XML parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        parts = [z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist()) if kind in OFFICE and re.fullmatch(OFFICE[kind], n)]
                    runs = [t for p in parts for t in re.findall(r"<(?:\w+:)?t(?: [^>]*)?>([^<]*)<|</(?:\w+:)?(?:p|row)>", p)]
                    out.append((path, "\n".join(t for t in runs if t)))
                except zipfile.BadZipFile:
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def tickets_from_json(spark: SparkSession, folder: str) -> DataFrame:
    """Landing files of issues, flattened; rows that are pull requests are dropped."""
    schema = "id string, key string, title string, body string, state string, created_at string, pull_request struct<url:string>, fields struct<summary:string,description:string,status:struct<name:string>,priority:struct<name:string>,created:string>"
    j = spark.read.schema(schema).json(folder).where("pull_request is null")
    return j.select(F.coalesce("key", "id").alias("id"), F.coalesce("fields.summary", "title").alias("title"), F.substring(F.coalesce("fields.description", "body", F.lit("")), 1, 500).alias("description"), F.coalesce("fields.status.name", "state").alias("status"), F.coalesce("fields.priority.name", F.lit("medium")).alias("priority"), F.coalesce("fields.created", "created_at").cast("timestamp").alias("created"))


def git_log(spark: SparkSession, folder: str) -> DataFrame:
    """Commits of ``git log --format=%H%n%an%n%aI%n%s`` files: four lines each."""
    lines = texts(spark, folder).select("path", F.posexplode(F.split(F.rtrim("content"), "\n")).alias("n", "line"))
    g = lines.groupBy("path", F.floor(F.col("n") / 4).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("v"))
    return g.where(F.size("v") == 4).select("path", *(F.col("v")[i].alias(c) for i, c in enumerate(("commit", "author", "at", "subject"))))


def bpmn(rows: DataFrame, key: str = "id", xml: str = "content") -> DataFrame:
    """(key, a, b) of a process's sequence flows."""
    flat = F.regexp_replace(F.col(xml), r"\bbpmn\d?:", "")
    pairs = F.arrays_zip(F.regexp_extract_all(flat, F.lit(r'<sequenceFlow[^>]*sourceRef="([^"]+)"'), F.lit(1)).alias("a"), F.regexp_extract_all(flat, F.lit(r'<sequenceFlow[^>]*targetRef="([^"]+)"'), F.lit(1)).alias("b"))
    return rows.select(F.col(key), F.explode(pairs).alias("p")).select(key, "p.a", "p.b")


def drawio(rows: DataFrame, key: str = "id", xml: str = "content") -> DataFrame:
    """(key, a, b) of a drawing's edges."""
    tag = F.regexp_extract_all(F.col(xml), F.lit(r'<mxCell[^>]*\bedge="1"[^>]*>'), F.lit(0))
    attr = lambda t, name: F.regexp_extract(t, rf'\b{name}="([^"]*)"', 1)
    return rows.select(F.col(key), F.explode(tag).alias("t")).select(key, attr(F.col("t"), "source").alias("a"), attr(F.col("t"), "target").alias("b")).where("a <> '' and b <> ''")


def webdav_entries(xml: Column) -> Column:
    """Hrefs of a PROPFIND answer but for the first, which is the folder itself."""
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<(?:\w+:)?href>([^<]+)</"), F.lit(1))
    return F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))


def trace_lines(steps: DataFrame) -> DataFrame:
    """One JSON line a request (request, step, latency_ms), with the sum of its steps."""
    g = steps.groupBy("request").agg(F.sum("latency_ms").alias("duration_ms"), F.array_sort(F.collect_list("step")).alias("steps"))
    return g.select(F.to_json(F.struct("request", "duration_ms", "steps")).alias("value"))


def requirements(files: DataFrame, source: str = "local") -> DataFrame:
    """Requirements from whole texts (path, content): the first 500 characters describe one, its bullets are the criteria."""
    rows = acceptance_criteria(files.withColumn("_row", F.struct("path", "content")), "_row", "content")
    return rows.select(
        F.col("_row.path").alias("id"),
        F.lit(source).alias("source"),
        F.element_at(F.split("_row.path", "/"), -1).alias("title"),
        F.substring(F.coalesce("_row.content", F.lit("")), 1, 500).alias("description"),
        F.lit("active").alias("status"),
        F.lit("requirement").alias("type"),
        "criteria",
    )


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vector rows in folders by source type, which scans prune."""
    rows.write.mode("append").partitionBy("source_type").parquet(path)


def page_tree(spark: SparkSession, pages: DataFrame, root: str, depth: int = 10) -> DataFrame:
    """(id, depth) of the pages (id, parent) under a root: a recursive query."""
    pages.createOrReplaceTempView("_siltstone_pages")
    return spark.sql("with recursive t(id, depth) as (select cast(:root as string), 0 union all select p.id, t.depth + 1 from _siltstone_pages p join t on p.parent = t.id where t.depth < :depth) select id, min(depth) as depth from t group by id", args={"root": root, "depth": depth})
