"""Line dedup: content-defined chunks of lines that stand elsewhere too.

A rolling hash over the hashes of the last two lines chooses chunk borders, so borders shift
with the content. Chunks of two lines or more are grouped by their hash and bytes; a chunk
that occurs again stays in one place (``dedup_lines``).

``dedup_runs`` then completes what the borders missed, since a repeated run need not be cut
alike in both places: where chunks left a line, each pair of adjacent lines and each line of
over 50 words is a window, and the lines of every window that also stands at an earlier place
go too. So every repeated run of two lines or more goes, wherever it begins and ends. Places
are ordered by doc_id, text hash and line, and the first place of every line is kept. Windows
are grouped by their SHA-256.

Grouping is partially aggregated, so a window that a third of all documents hold costs a row
a task; the joins are between plain scans, whose hot keys Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.shared import give_back, materialise, require, text_or_empty

#: Lines under the rolling hash, the share of lines that end a chunk (1 in so many), and the least lines of a chunk.
WINDOW, EVERY, LEAST = 2, 2, 2
NO_ID = 2**63 - 1
#: A line of more words than this is a passage of its own.
LONG = 50
ADDED = ("n_lines", "n_removed_lines", "n_removed_chunks")


def chunks(text: str, every: int = EVERY, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, lines) of each chunk of the text, in characters; lines keep their ends."""
    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()  # the text is empty or its last line has an end
    hashes = [xxhash.xxh3_64_intdigest(p.encode()) for p in lines]
    out, start, at, n = [], 0, 0, 0
    for k, p in enumerate(lines):
        at, n = min(at + len(p) + 1, len(text)), n + 1
        rolled = 0
        for h in hashes[max(0, k - WINDOW + 1) : k + 1]:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
        if n >= least and (rolled >> 33) % every == 0:
            out.append((start, at, n))
            start, n = at, 0
    if n:
        out.append((start, at, n))
    return out


def chunk_rows(rows: DataFrame, with_text: bool, every: int, least: int) -> DataFrame:
    """A row for each chunk of ``least`` lines with a visible character: its place and hash, and its text if wanted; rows: key, row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch, cols = whole.slice(a, 500), [[] for _ in range(7)]
                texts = batch.column(2).to_pylist()
                for r, text in enumerate(texts):
                    seen: set[bytes] = set()
                    line = 0
                    for start, end, n in chunks(text, every, least):
                        part = text[start:end].removesuffix("\n")
                        if n >= least and not part.isspace():
                            digest = xxhash.xxh3_128_digest(part.encode())
                            for col, v in zip(cols, (r, line, start, end, n, digest not in seen, digest if not with_text else (digest, part))):
                                col.append(v)
                            seen.add(digest)
                        line += n
                at = pa.array(cols[0], pa.int32())
                place = [batch.column(0).take(at), batch.column(1).take(at), pa.array(cols[1], pa.int32())]
                if with_text:
                    yield pa.RecordBatch.from_arrays([*place, pa.array([d for d, _ in cols[6]], pa.binary()), pa.array([t for _, t in cols[6]], pa.string())], names=["key", "row", "line", "h", "chunk"])
                else:
                    yield pa.RecordBatch.from_arrays([*place, *(pa.array(c, pa.int32()) for c in cols[2:5]), pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.binary())], names=["key", "row", "line", "start", "end", "n", "first", "h"])
        give_back()

    return rows.mapInArrow(run, "key long, row long, line int, h binary, chunk string" if with_text else "key long, row long, line int, start int, end int, n int, first boolean, h binary")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("row"), text_or_empty().alias("text"))


def windows(text: str, least: int = LEAST, long: int = LONG) -> Iterator[tuple[int, int, int, int, str]]:
    """(first line, start, end, lines, content) of all runs of ``least`` lines and of each longer line alone, if a character is visible."""
    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()
    at = [0]
    for p in lines:
        at.append(min(at[-1] + len(p) + 1, len(text)))
    for k, p in enumerate(lines):
        if least > 1 and len(p) > 2 * long and len(p.split()) > long:
            yield k, at[k], at[k + 1], 1, p
        if k + least <= len(lines):
            part = "\n".join(lines[k : k + least])
            if part and not part.isspace():
                yield k, at[k], at[k + least], least, part


def window_rows(rows: DataFrame, least: int, long: int) -> DataFrame:
    """(key, row, line, start, end, n, h) of each window; rows: key, row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch, cols = whole.slice(a, 500), [[] for _ in range(6)]
                for r, text in enumerate(batch.column(2).to_pylist()):
                    for k, start, end, n, part in windows(text, least, long):
                        for col, v in zip(cols, (r, k, start, end, n, hashlib.sha256(part.encode()).digest())):
                            col.append(v)
                at = pa.array(cols[0], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.int32()) for c in cols[1:5]), pa.array(cols[5], pa.binary())], names=["key", "row", "line", "start", "end", "n", "h"])
        give_back()

    return rows.mapInArrow(run, "key long, row long, line int, start int, end int, n int, h binary")


def united(found: DataFrame) -> DataFrame:
    """(key, row, _spans): windows of each text that overlap or touch become one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                spans: list[dict] = []
                for w in parts:
                    if spans and w["line"] <= spans[-1]["to"]:
                        last = spans[-1]
                        last["to"], last["end"] = max(last["to"], w["line"] + w["n"]), max(last["end"], w["end"])
                    else:
                        spans.append({"line": w["line"], "to": w["line"] + w["n"], "start": w["start"], "end": w["end"]})
                out.append([{"start": s["start"], "end": s["end"], "n": s["to"] - s["line"]} for s in spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["key", "row", "_spans"])

    held = found.groupBy("key", "row").agg(F.array_sort(F.collect_set(F.struct("line", "n", "start", "end"))).alias("w"))
    return held.mapInArrow(run, "key long, row long, _spans array<struct<start: int, end: int, n: int>>")


def dedup_runs(docs: DataFrame, every: int = EVERY, least: int = LEAST, long: int = LONG) -> DataFrame:
    """All rows of ``docs`` without the lines of repeated chunks and runs in ``text``, and counts as in ``dedup_lines``.

    A line goes if a chunk or a run of ``least`` lines that holds it, or the line itself if it
    has over ``long`` words, also stands at an earlier place; ``n_removed_chunks`` counts the
    stretches that go. The first place of a line stays, but what stays of a run can be in
    several places where runs overlap. Shorter lines that are repeated alone stay, and so do
    runs of white space. Null, empty and equal rows are treated as in ``dedup_lines``; rows
    with one doc_id and different texts are documents of their own.
    """
    require(docs, ["doc_id", "text"])
    docs = docs.drop(*ADDED)
    rows, place = keyed(docs), F.struct("key", "row", "line")
    columns = ["key", "row", "line", "n", "start", "end"]
    same = chunk_rows(rows, True, every, least).groupBy("h", "chunk").agg(F.count("*").alias("times"), F.min(place).alias("owner"))
    repeated = materialise(same.groupBy("h").agg(F.sum("times").alias("times"), F.min("owner").alias("owner"), F.count("*").alias("texts")).where("times > 1 and texts = 1").select("h", "owner"), "lines-repeated")
    gone = materialise(chunk_rows(rows, False, every, least).join(repeated, "h").where(place != F.col("owner")).select(*columns), "lines-gone")

    held = gone.groupBy("key", "row").agg(F.collect_set(F.struct("line", "n")).alias("_gone"))
    inside = F.exists("_gone", lambda c: (c["line"] <= F.col("line")) & (F.col("line") + F.col("n") <= c["line"] + c["n"]))
    left = window_rows(rows, least, long).join(held, ["key", "row"], "left").where(F.coalesce(~inside, F.lit(True))).drop("_gone")
    left = materialise(left, "lines-windows")
    again = materialise(left.groupBy("h").agg(F.count("*").alias("times"), F.min(place).alias("owner")).where("times > 1").select("h", "owner"), "lines-again")
    more = left.join(again, "h").where(place != F.col("owner")).select(*columns)
    return cut(docs, materialise(united(gone.unionByName(more)), "lines-spans"))


def dedup_lines(docs: DataFrame, every: int = EVERY, least: int = LEAST) -> DataFrame:
    """All rows of ``docs`` with repeated chunks removed from ``text``, and counts.

    Added: ``n_lines``, ``n_removed_lines``, ``n_removed_chunks`` (longs; columns of these names are replaced). A text without
    repeats stays as it is, a null text stays null, an empty one empty (0 lines). Rows equal
    in doc_id and text are one document; a null doc_id counts as the largest. Single lines
    and chunks of white space are never removed; neither is a chunk whose 128-bit hash two
    different texts share.
    """
    require(docs, ["doc_id", "text"])
    docs = docs.drop(*ADDED)
    rows = keyed(docs)
    same = chunk_rows(rows, True, every, least).groupBy("h", "chunk").agg(F.count("*").alias("times"), F.min("key").alias("owner"))
    repeated = materialise(same.groupBy("h").agg(F.sum("times").alias("times"), F.min("owner").alias("owner"), F.count("*").alias("texts")).where("times > 1 and texts = 1").select("h", "owner"), "lines-repeated")
    found = materialise(chunk_rows(rows, False, every, least), "lines-chunks").join(repeated, "h").where(~((F.col("key") == F.col("owner")) & F.col("first")))
    spans = found.select("key", "row", F.struct("start", "end", "n").alias("span")).groupBy("key", "row").agg(F.array_sort(F.collect_set("span")).alias("_spans"))
    return cut(docs, materialise(spans, "lines-spans"))


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the spans (key, row, _spans: sorted and disjoint structs of start, end, n) of their texts, and counts."""
    spans = spans.withColumnsRenamed({"key": "_key", "row": "_row"})
    # by sort and merge at every size, so that cost grows in proportion
    whole = docs.join(spans.hint("merge"), (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_key")) & (F.xxhash64("text") == F.col("_row")), "left")
    n = F.size("_spans")
    before = lambda i: F.when(i > 0, F.element_at("_spans", F.greatest(i, F.lit(1)))["end"]).otherwise(0)
    after = lambda i: F.when(i < n, F.element_at("_spans", F.least(i + 1, n))["start"]).otherwise(F.length("text"))
    kept = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.substr(F.col("text"), before(i) + 1, after(i) - before(i))), "")
    lines = F.when(F.length("text") > 0, F.length("text") - F.length(F.regexp_replace("text", "\n", "")) + (~F.endswith("text", F.lit("\n"))).cast("int")).otherwise(0)
    none = F.col("_spans").isNull()
    return whole.select(
        *(F.when(none, F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("_spans", F.lit(0), lambda a, s: a + s["n"]), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce(F.when(none, 0).otherwise(n), F.lit(0)).cast("long").alias("n_removed_chunks"),
    )
