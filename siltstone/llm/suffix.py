"""Removal of byte strings that occur again, by sampled suffixes and induction.

Suffix sorting over a corpus need not look at every suffix. Each 200-byte window picks one
sampled suffix, the leftmost of its 32-byte grams with the least hash, so equal windows pick
the same one at the same place. Spark's external sort (spilled runs, merged by priority
queues) brings together the tuples of sampled suffixes; the windows around them, and how far
their common parts reach, are then induced from the samples:

1. tuples (gram, context, place) of the samples are grouped; a sample whose gram is unique
   settles that its windows are unique, one whose whole context recurs that all recur;
2. what is left, mostly at the ends of repeated passages, recurs in a second round: the
   contexts of one gram are compared window by window, in blocks, and for grams with more
   contexts than a block also across blocks;
3. windows found to recur are put back into their documents.

Samples are about 1 in 85 of the bytes, so the data that is sorted is smaller than the text.
No group is gathered whole: groups are counted with partial aggregates, blocks are bounded,
joins are between scans, whose hot keys Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.shared import materialise, require, text_or_empty

#: Bytes of a string that is searched, of the grams that are sampled, and contexts a block.
LENGTH, GRAM, BLOCK = 200, 32, 512
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_TABLES = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_TABLES[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            with np.errstate(over="ignore"):
                _TABLES[k] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * n, base, np.uint64))])
    return _TABLES[0], _TABLES[1]


class Hashes:
    """Polynomial hashes of any substrings of some bytes, from prefix sums."""

    def __init__(self, data: bytes):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def samples(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of one document: place p, before, after, gram and context hashes.

    Sample p serves the windows that start at p - before and at the ``after`` places behind.
    """
    span = length - gram + 1
    n = len(data) - gram + 1
    if n < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes = Hashes(data)
    at = np.arange(n)
    g = hashes.of(at, at + gram)
    low, size = g, 1  # least hash of each window, by doubling
    while size < span:
        step = min(size, span - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    # a window has another sample than the one before if the least changes or has just been left behind
    new = np.concatenate([[0], np.flatnonzero((low[1:] != low[:-1]) | (g[: len(low) - 1] == low[:-1])) + 1])
    places = np.empty(len(new), np.int64)
    for a in range(0, len(new), 4096):
        part = new[a : a + 4096]
        places[a : a + 4096] = part + np.lib.stride_tricks.sliding_window_view(g, span)[part].argmin(axis=1)
    last = np.concatenate([new[1:] - 1, [len(low) - 1]])
    before, after = places - new, last - new  # windows: places - before, and so many more
    context = hashes.of(new, last + length)
    return places, before, after, g[places], mixed(context + mixed((before * 65536 + after).astype(np.uint64)))


SAMPLE = "row long, p int, before int, after int, gram long, context long"


def sample_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The samples of all documents; rows: row, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch = whole.slice(a, 500)
                found = [samples(d.as_py(), length, gram) for d in batch.column(1)]
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f[0]) for f in found])
                p, before, after, g, c = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (p, before, after)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], names=["row", "p", "before", "after", "gram", "context"])

    return rows.mapInArrow(run, SAMPLE)


def contexts(rows: DataFrame, wanted: DataFrame, length: int, block: int) -> DataFrame:
    """The bytes around the wanted samples (row, p, before, after, gram, kinds)."""
    listed = wanted.groupBy("row").agg(F.collect_list(F.struct("p", "before", "after", "gram", "kinds")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 200):
                batch, out = whole.slice(a, 200), []
                for row, data, found in zip(*(batch.column(k) for k in range(3))):
                    row, data = row.as_py(), data.as_py()
                    for s in found.as_py():
                        first = s["p"] - s["before"]
                        many = -(-s["kinds"] // block)
                        out.append((s["gram"], hash((row, s["p"])) % many, many > 1, row, first, s["before"], data[first : first + s["after"] + length]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["gram", "salt", "hot", "row", "first", "before", "bytes"])

    return rows.join(listed.hint("merge"), "row").select("row", "data", "list").mapInArrow(run, "gram long, salt int, hot boolean, row long, first int, before int, bytes binary")


def reach(found: DataFrame, side: str) -> DataFrame:
    """Adds how many bytes to the ``left`` or ``right`` of the gram agree with any other context of the gram.

    Contexts are sorted by what stands on that side, outwards; the longest common part of one
    is that with a neighbour in the order. Ranges of the order are dealt to tasks and may cut
    a gram, so the first and last row of a task count as agreeing altogether.
    """
    left = side == "left"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, before = None, None, _ALL
        for batch in batches:
            keys = list(zip(batch.column("gram").to_pylist(), batch.column(side).to_pylist()))
            common = [_ALL if last is None else shared_prefix(last, keys[0])] if keys else []
            common += [shared_prefix(a, b) for a, b in zip(keys, keys[1:])]
            if held is not None and keys:
                yield held.append_column(f"{side}_reach", pa.array([*before[:-1], max(before[-1], common[0])], pa.int32()))
            if keys:
                own = [max(a, b) for a, b in zip(common, [*common[1:], 0])]
                held, last, before = batch, keys[-1], own
        if held is not None:
            yield held.append_column(f"{side}_reach", pa.array([*before[:-1], _ALL], pa.int32()))

    order = ["gram", "left", "right"] if left else ["gram", "right", "left"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + f", {side}_reach int"
    return found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


#: Longer than any context.
_ALL = 1_000_000


def shared_prefix(a: tuple[int, bytes], b: tuple[int, bytes]) -> int:
    """Length of the common beginning of two sides of equal grams, by halving; 0 for other grams."""
    if a[0] != b[0]:
        return 0
    x, y, low = a[1], b[1], 0
    high = min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
    return low


def compare(found: DataFrame, length: int, gram: int) -> DataFrame:
    """Windows that recur among the contexts of a block (from, to), and for grams of several blocks the distinct windows (key) that may recur in others.

    A window recurs only if its bytes on either side of the gram do, each for itself.
    """

    size_of_gram = gram

    def work(g: list[list]) -> pa.RecordBatch:
        gram, hot, row, first, before = (np.array(c) for c in (g[0], g[2], g[3], g[4], g[5]))
        sizes = np.array([len(b) for b in g[6]])
        windows = sizes - length + 1
        base = np.repeat(np.cumsum(sizes) - sizes, windows)
        j = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        of = np.repeat(np.arange(len(sizes)), windows)
        plain = Hashes(b"".join(g[6])).of(base + j, base + j + length)
        shift = (before[of] - j).astype(np.uint64)
        key = mixed(plain + mixed(gram[of].view(np.uint64) + shift * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twin = np.zeros(len(key), bool)
        twin[order[1:]] |= same
        twin[order[:-1]] |= same
        edge = np.diff(np.concatenate([[0], twin.astype(np.int8), [0]]))
        one, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        # runs end with their contexts
        cut = np.flatnonzero(np.diff(of) != 0)
        inner = cut[np.searchsorted(one, cut, "right") > np.searchsorted(end, cut, "left")] if len(one) else cut[:0]
        inner = inner[twin[inner] & twin[inner + 1]] if len(inner) else inner
        one, end = np.sort(np.concatenate([one, inner + 1])), np.sort(np.concatenate([end, inner]))
        lead = np.zeros(len(key), bool)
        lead[order[np.concatenate([[True], ~same])] if len(order) else order] = True
        to_left = before[of] - j
        far = np.flatnonzero(lead & hot[of] & (to_left <= np.array(g[7])[of]) & (length - size_of_gram - to_left <= np.array(g[8])[of]))
        start = first[of] + j
        cols = [np.concatenate([row[of[one]], row[of[far]]]), np.concatenate([start[one], start[far]]), np.concatenate([start[end], start[far]]), np.concatenate([np.zeros(len(one), np.int64), key[far].view(np.int64)]), np.concatenate([np.zeros(len(one), np.int64), gram[of[far]]])]
        is_far = np.concatenate([np.zeros(len(one), bool), np.ones(len(far), bool)])
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(is_far)], names=["row", "from", "to", "key", "gram", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [[] for _ in range(9)], None
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if values[:2] != last and len(held[0]) >= 2000:
                    yield work(held)
                    held = [[] for _ in range(9)]
                last = values[:2]
                for col, v in zip(held, values):
                    col.append(v)
        if held[0]:
            yield work(held)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = list(zip(batch.column("before").to_pylist(), batch.column("bytes").to_pylist()))
            batch = batch.append_column("left", pa.array([b[:n][::-1] for n, b in cut], pa.binary()))
            yield batch.append_column("right", pa.array([b[n + size_of_gram :] for n, b in cut], pa.binary()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    sides = found.where("hot").mapInArrow(split, f"{kinds}, left binary, right binary")
    sides = reach(reach(sides, "left"), "right").drop("left", "right")
    cold = found.where("not hot").withColumns({"left_reach": F.lit(_ALL), "right_reach": F.lit(_ALL)})
    dealt = cold.unionByName(sides).repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    return dealt.mapInArrow(run, "row long, from int, to int, key long, gram long, far boolean")


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(row, from, to): starts of all windows of ``length`` bytes that start elsewhere too; rows: row, data."""
    found = materialise(sample_rows(rows, length, gram), "suffix-samples")
    kinds = materialise(found.groupBy("gram", "context").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("row", "p", "before", "after"))), "suffix-contexts")
    grams = materialise(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-grams")
    whole = kinds.where("n > 1").select("gram", "context")
    marks = found.join(whole, ["gram", "context"]).select("row", (F.col("p") - F.col("before")).alias("from"), (F.col("p") - F.col("before") + F.col("after")).alias("to"))
    wanted = kinds.join(grams, "gram").select("row", "p", "before", "after", "gram", F.col("kinds").cast("int").alias("kinds"))
    around = materialise(contexts(rows, wanted, length, block), "suffix-around")
    near = materialise(compare(around, length, gram), "suffix-compared")
    far = near.where("far").select("key", "gram", "row", "from", "to")
    again = materialise(far.groupBy("key", "gram").agg(F.count("*").alias("n")).where("n > 1").select("key", "gram"), "suffix-far")
    return marks.union(near.where("not far").select("row", "from", "to")).union(far.join(again, ["key", "gram"]).select("row", "from", "to"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` also ``kept binary``.

    Texts are UTF-8 bytes, null ones empty; each byte under a ``length``-byte string that
    also starts anywhere else in the input, the same document included, is removed. Shorter
    texts keep everything. Repeated rows count as documents of their own, so a text of
    ``length`` bytes or more that stands twice goes altogether. Extra columns are ignored, and
    an empty table gives an empty one. A text is hashed whole in its task, with about ten
    8-byte numbers a byte: one of 100 MB takes some 10 GB there, so texts of that size need
    workers to match or must be parted before. Windows are told apart by 64-bit hashes.
    """
    require(docs, ["doc_id", "text"])
    rows = docs.select(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.encode(text_or_empty(), "UTF-8").alias("data"))
    kind = rows.schema[0].dataType.simpleString()
    marks = repeated_windows(rows.select("row", "data"), length, gram, block).groupBy("row").agg(F.collect_set(F.struct("from", "to")).alias("marks"))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch, out = whole.slice(a, 500), []
                for data, found in zip(batch.column(1), batch.column(2)):
                    data, kept, spans, gone = data.as_py(), data.as_py(), 0, 0
                    if found.is_valid:
                        flat = found.values.flatten()
                        cover = np.zeros(len(data) + 1, np.int32)
                        np.add.at(cover, flat[0].to_numpy(zero_copy_only=False), 1)
                        np.add.at(cover, flat[1].to_numpy(zero_copy_only=False) + length, -1)
                        removed = np.cumsum(cover[:-1]) > 0
                        spans = int(np.count_nonzero(removed[1:] & ~removed[:-1]) + removed[0])
                        gone = int(removed.sum())
                        kept = np.frombuffer(data, np.uint8)[~removed].tobytes()
                    out.append((len(data), gone, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return rows.join(marks.hint("merge"), "row", "left").select("doc_id", "data", "marks").mapInArrow(run, schema)
