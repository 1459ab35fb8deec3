"""Vector code compression: product quantisation, fitted by Lloyd's rounds with heaps.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook.
Rows stand in blocks of ``BLOCK``, one record of a written table each. A block keeps, for
each part position and entry, a heap of the parts assigned to that entry, keyed by their
slack: a lower bound of the distance to the second nearest entry minus an upper bound of the
distance to their own, plus the entry's drift when the bounds were taken. An entry's drift
grows each round by how far it moved plus how far any other entry moved at most. Only parts
whose key its drift has reached can have another nearest entry: they are popped and measured
against all entries in whole numbers. Bounds are rounded outwards, so results are exact.

A round is one narrow pass that rewrites the blocks, and a sum by entry and component of what
the blocks hold (updated where parts move); codebooks alone reach the driver. A block's state
depends on nothing but its record and the codebooks, so a lost task is simply run again. The
blocks of a round go when those of the next are written.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.shared import materialise, remove, require, written
from siltstone.llm.whitening import usable

#: Steps of a component in a unit, parts a vector, entries a codebook, rounds, and vectors a block.
STEPS, PARTS, ENTRIES, ROUNDS, BLOCK = 4096, 8, 16, 6, 4096
#: Relative room for the rounding of bounds.
ROOM = 1e-11


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: the nearest entry (lowest of equals), its squared distance and that to the next."""
    apart = x[:, None, :] - book[None, :, :]
    square = np.einsum("rec,rec->re", apart, apart)
    best = square.argmin(axis=1)
    at = np.arange(len(x))
    own = square[at, best]
    square[at, best] = np.iinfo(np.int64).max
    return best, own, square.min(axis=1)


def slack(own: np.ndarray, other: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Keys: lower minus upper bound, plus the drift so far of the entry; rounded down."""
    low, high = np.sqrt(other.astype(np.float64)), np.sqrt(own.astype(np.float64))
    return low - high + drift - ROOM * (low + high + drift)


class Block:
    """The vectors of one record (rows x parts x components), their heaps, and sums and counts by part and entry.

    Heaps are stored as they lie: ``order`` (rows) and ``keys`` of each part position hold the
    entries' heaps one behind the other, ``sizes`` their lengths. A heap is turned into a list
    only if its first key has been reached or a part is pushed onto it.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray, keys: np.ndarray, sizes: np.ndarray, sums: np.ndarray):
        self.x, self.order, self.keys, self.sizes, self.sums = x, order, keys, sizes, sums

    @classmethod
    def start(cls, x: np.ndarray, books: np.ndarray) -> "Block":
        """Every part measured against all entries of ``books``, with no drift yet."""
        rows, parts, size = x.shape
        entries = books.shape[1]
        block = cls(x, np.zeros((parts, rows), np.int32), np.zeros((parts, rows)), np.zeros((parts, entries), np.int32), np.zeros((parts, entries, size + 1), np.int64))
        for p, book in enumerate(books):
            own = x[:, p].astype(np.int64)
            best, near, other = nearest(own, book)
            np.add.at(block.sums[p], best, np.concatenate([own, np.ones((rows, 1), np.int64)], axis=1))
            keys = slack(near, other, np.zeros(rows))
            heaps = {e: list(zip(keys[at].tolist(), at.tolist())) for e in range(entries) if len(at := np.flatnonzero(best == e))}
            for heap in heaps.values():
                heapq.heapify(heap)
            block._store(p, heaps)
        return block

    def _heap(self, p: int, entry: int, heaps: dict[int, list[tuple[float, int]]]) -> list[tuple[float, int]]:
        if entry not in heaps:
            a = int(self.sizes[p, :entry].sum())
            b = a + int(self.sizes[p, entry])
            heaps[entry] = list(zip(self.keys[p, a:b].tolist(), self.order[p, a:b].tolist()))
        return heaps[entry]

    def _store(self, p: int, heaps: dict[int, list[tuple[float, int]]]) -> None:
        ends = np.cumsum(self.sizes[p])
        order, keys = [], []
        for entry, end in enumerate(ends):
            if entry in heaps:
                keys.append(np.array([k for k, _ in heaps[entry]], np.float64))
                order.append(np.array([r for _, r in heaps[entry]], np.int32))
            else:
                part = slice(end - self.sizes[p, entry], end)
                keys.append(self.keys[p, part])
                order.append(self.order[p, part])
        self.keys[p], self.order[p], self.sizes[p] = np.concatenate(keys), np.concatenate(order), [len(k) for k in keys]

    def codes(self) -> np.ndarray:
        """The entry of each part, rows x parts."""
        out = np.empty(self.x.shape[:2], np.int64)
        for p, sizes in enumerate(self.sizes):
            out[self.order[p], p] = np.repeat(np.arange(len(sizes)), sizes)
        return out

    def assign(self, books: np.ndarray, drift: np.ndarray) -> int:
        """Pop and measure the parts whose keys the drift (part x entry) has reached; how many."""
        seen = 0
        for p, book in enumerate(books):
            heaps: dict[int, list[tuple[float, int]]] = {}
            popped: list[int] = []
            before: list[int] = []
            first = np.cumsum(self.sizes[p]) - self.sizes[p]
            for entry in range(len(book)):
                limit = drift[p, entry]
                if not self.sizes[p, entry] or self.keys[p, first[entry]] > limit:
                    continue
                heap = self._heap(p, entry, heaps)
                while heap and heap[0][0] <= limit:
                    popped.append(heapq.heappop(heap)[1])
                    before.append(entry)
            if not popped:
                continue
            x = self.x[popped, p].astype(np.int64)
            best, own, other = nearest(x, book)
            for key, entry, row in zip(slack(own, other, drift[p, best]).tolist(), best.tolist(), popped):
                heapq.heappush(self._heap(p, entry, heaps), (key, row))
            self._store(p, heaps)
            moved = best != before
            whole = np.concatenate([x[moved], np.ones((int(moved.sum()), 1), np.int64)], axis=1)
            np.subtract.at(self.sums[p], np.array(before)[moved], whole)
            np.add.at(self.sums[p], best[moved], whole)
            seen += len(popped)
        return seen

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, summed over parts."""
        codes, total = self.codes(), np.zeros(len(self.x), np.int64)
        for p, book in enumerate(books):
            apart = self.x[:, p].astype(np.int64) - book[codes[:, p]]
            total += (apart * apart).sum(axis=1)
        return total


def stored(x: np.ndarray) -> np.ndarray:
    """The vectors in two or four bytes a component; squared distances must fit a long."""
    most = max(int(x.max()), -int(x.min()), 1)
    if x.shape[2] * (2 * most) ** 2 >= 2**62:
        raise OverflowError(f"a component of {most} steps: squared distances would not fit a long")
    return x.astype(np.int16 if most < 2**15 else np.int32)


def next_books(sums: np.ndarray, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries moved to the floor of their parts' means, and the drift grown by those moves."""
    count = sums[:, :, -1:]
    moved = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
    far = np.sqrt(((moved - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + ROOM)
    by_size = np.argsort(far, axis=1)
    part = np.arange(len(far))
    most = np.repeat(far[part, by_size[:, -1]][:, None], far.shape[1], axis=1)
    most[part, by_size[:, -1]] = far[part, by_size[:, -2]] if far.shape[1] > 1 else 0  # the farthest other entry
    return moved, drift + far + most


def encode(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row for each usable vector.

    Vectors that are null or hold a null or non-finite component are dropped; the others must
    have one length, a multiple of ``parts``. The first entries are the parts of the smallest
    vec_ids, nulls last, equal ids by their vectors; with fewer vectors than ``entries``
    codebooks are shorter. Distances are compared as whole numbers, ties go to the lower
    index. Repeated rows count as often as they stand; null labels are one label. Extra
    columns are ignored, and an empty table gives an empty one. ``error`` sums the final
    squared distances of a vector's parts, ``label_error`` those of its label.
    """
    require(embeddings, ["vec_id", "embedding", "label"])
    spark = embeddings.sparkSession
    vec, lab = (embeddings.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    kept = embeddings.where(usable()).select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * STEPS)).alias("x"))
    first = [r["x"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    if not first:
        return spark.createDataFrame([], f"vec_id {vec}, code string, error long, label_error long, codebooks_sha256 string")
    dims = len(first[0])
    if other := [len(v) for v in first if len(v) != dims]:
        raise ValueError(f"vectors of {dims} and of {other[0]} components")
    if dims % parts or not dims:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    size = dims // parts
    books = np.array(first, np.int64).reshape(-1, parts, size).swapaxes(0, 1)
    drift = np.zeros(books.shape[:2])
    kinds = [("n", "int"), ("x", "binary"), ("order", "binary"), ("keys", "binary"), ("sizes", "binary"), ("sums", "array<long>")]
    schema = f"ids array<{vec}>, labels array<{lab}>, " + ", ".join(f"{n} {k}" for n, k in kinds)

    def record(ids: pa.Array, labels: pa.Array, b: Block) -> pa.RecordBatch:
        own = [pa.array([len(b.x)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (b.x, b.order, b.keys, b.sizes)), pa.array([b.sums.ravel().tolist()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([ids, labels, *own], names=["ids", "labels", *(n for n, _ in kinds)])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), block):
                batch = whole.slice(a, block)
                lengths = np.diff(batch.column(2).offsets.to_numpy())
                if (lengths != dims).any():
                    raise ValueError(f"vectors of {dims} and of {lengths[lengths != dims][0]} components")
                x = stored(batch.column(2).flatten().to_numpy().reshape(len(batch), parts, size))
                one = pa.array([0, len(batch)], pa.int32())
                yield record(pa.ListArray.from_arrays(one, batch.column(0)), pa.ListArray.from_arrays(one, batch.column(1)), Block.start(x, shared.value[0]))

    def opened(batch: pa.RecordBatch, i: int) -> Block:
        n, x, order, keys, sizes = (batch.column(c)[i].as_py() for c in range(2, 7))
        kind = np.int16 if len(x) == 2 * n * dims else np.int32
        own = np.array(batch.column(7)[i].as_py(), np.int64).reshape(parts, -1, size + 1)
        return Block(np.frombuffer(x, kind).reshape(n, parts, size), np.frombuffer(order, np.int32).reshape(parts, n).copy(), np.frombuffer(keys).reshape(parts, n).copy(), np.frombuffer(sizes, np.int32).reshape(parts, -1).copy(), own)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                b = opened(batch, i)
                b.assign(*shared.value)
                yield record(batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), b)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                b = opened(batch, i)
                b.assign(*shared.value)
                codes = [bytes(c).hex() for c in b.codes().astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten(), pa.array(codes, pa.string()), pa.array(b.errors(shared.value[0]))], names=["vec_id", "label", "code", "error"])

    shared = spark.sparkContext.broadcast((books, drift))  # a few thousand numbers
    blocks, path = written(kept.mapInArrow(begin, schema), "codes-blocks")
    for turn in range(rounds):
        sums = np.zeros(books.size + drift.size, np.int64)
        for r in blocks.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
            sums[r["at"]] = r["v"]
        books, drift = next_books(sums.reshape(*books.shape[:2], size + 1), books, drift)
        shared = spark.sparkContext.broadcast((books, drift))
        if turn < rounds - 1:
            held = path
            blocks, path = written(blocks.mapInArrow(again, schema), "codes-blocks")
            remove(spark, held)
    rows = materialise(blocks.mapInArrow(finish, f"vec_id {vec}, label {lab}, code string, error long"), "codes-rows")
    remove(spark, path)
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
