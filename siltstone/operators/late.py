"""Late interaction: documents with a vector a token, scored by the sum of best matches.

The score of a document is, for each vector of the query, its best product with a vector of
the document, summed. The index groups token vectors in lists, one for each of a fixed number
of centroids, which are fitted on a bounded sample. Documents lie in blocks that hold their
vectors and the list of each. A task joins some blocks, so that a vector which many documents
share is compared once, and notes where a vector of a query meets a near one; elsewhere its
best product is known to be lower. That bounds the score of every document, and only those
that can be among the best are scored. ``candidates=None`` compares all vectors, so nothing
is missed; otherwise a query looks only at the lists nearest to its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from siltstone.operators.embedding import Hashing, words_of
from siltstone.storage import cut, give_back

#: Cells of a word's vector, lists of the index, vectors that they are fitted on at most, rounds of that.
DIMS, LISTS, SAMPLE, ROUNDS = 64, 512, 20_000, 8
#: Documents of a block; query vectors that go to the workers at a time; lists that one looks at; documents of a block that are scored exactly.
BLOCK, ASKED, PROBES, CANDIDATES = 1024, 65_536, 8, 128
#: Vectors of queries that a block's vectors are compared with at once; vectors of a group of queries, whose bounds (a byte a document) are held.
WORDS, GROUP = 256, 8192
#: Documents that a task joins from blocks, and their vectors, at most (one block may hold more); vectors compared at once.
JOINED, VECTORS, PANEL = 8192, 3_000_000, 8192
#: Bytes of text, or cells of vectors, in a block at most (one document may hold more).
TEXT, CELLS = 4 << 20, 4 << 20
#: Products from this share of the largest possible one on are noted; steps of a bound up to that; cells noted at once.
NEAR, STEPS, NOTED = 0.5, 200, 1 << 20
#: Documents of joined blocks that are scored one by one for a query; if more can be among the best, all are scored together.
SINGLE = 256
#: A block is megabytes, so pages and row groups are closed by size after each.
FEW = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.enable.dictionary": "false"}


def word_vectors(rows: DataFrame, key: str = "id", text: str = "content", dims: int = DIMS) -> DataFrame:
    """(key, vectors): a hashed vector of length 1 for each distinct word of a text, in order of first use; none for null texts."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Hashing(dims)
        for whole in batches:
            for a in range(0, len(whole), 200):
                batch, flat, counts = whole.slice(a, 200), [], []
                for t in batch.column(1).to_pylist():
                    found = words_of(t)
                    v = model(found).astype(np.float64) if found else np.zeros((0, dims))
                    norm = np.sqrt((v * v).sum(axis=1))
                    v = v[norm > 0] / norm[norm > 0, None]
                    flat.append(v.ravel())
                    counts.append(len(v))
                ends = np.cumsum([0, *counts])
                inner = pa.ListArray.from_arrays(pa.array(np.arange(ends[-1] + 1) * dims, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], names=["id", "vectors"])

    return rows.select(F.col(key).alias("id"), F.col(text)).mapInArrow(run, f"id {kind}, vectors array<array<double>>").withColumnRenamed("id", key)


def centroids(x: np.ndarray, lists: int = LISTS, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of a sample's groups; the first ones are spread over the sample in order."""
    x = np.unique(x, axis=0)
    if not len(x):
        return np.zeros((0, x.shape[1]))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], c)
    return c


@dataclass
class Index:
    """blocks: block, ids, counts (vectors of each document), tokens (which of the block's vectors), x (the block's distinct vectors, numbers of a ``kind``), lists (the centroid of each); centers: centroids.

    Vectors of whole numbers, as hashed words are, take a byte or two a cell and are scaled to
    length 1 when they are read.
    """

    blocks: DataFrame
    centers: np.ndarray


BLOCK_SCHEMA = "block long, ids array<long>, counts binary, tokens binary, x binary, kind string, lists binary"


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def _record(number: int, ids: pa.Array, counts: np.ndarray, tokens: np.ndarray, x: np.ndarray, centers: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    whole = np.issubdtype(x.dtype, np.integer)
    real = lambda part: unit(part.astype(np.float64)) if whole else part
    own = np.concatenate([(real(x[a : a + 2048]) @ centers.T).argmax(axis=1) for a in range(0, len(x), 2048)] or [np.zeros(0)])
    most = int(np.abs(x).max()) if whole and x.size else 0
    kind = "f8" if not whole else "i1" if most < 128 else "i4"
    held = [pa.array([y.tobytes()], pa.binary()) for y in (counts.astype(np.int32), tokens.astype(np.int32), x.astype(kind), own.astype(np.int32))]
    first = [pa.array([(TaskContext.get().partitionId() << 32) + number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
    return pa.RecordBatch.from_arrays([*first, *held[:3], pa.array([kind]), held[3]], names=[c.split(" ")[0] for c in BLOCK_SCHEMA.split(", ")])


def stretches(size: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """From and to of at most ``rows`` rows in a row whose sizes sum up to ``most`` at most (one row may be larger)."""
    upto, a = np.cumsum(size), 0
    while a < len(size):
        b = int(np.searchsorted(upto, most + (upto[a - 1] if a else 0), "right"))
        yield a, (b := min(max(b, a + 1), a + rows))
        a = b


def _drawn(rows: DataFrame, share: float) -> DataFrame:
    """Rows drawn by a hash of the id."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30)) + 1)


def _fitted(vectors: DataFrame, lists: int, sample: int) -> np.ndarray:
    x = [r["v"] for r in vectors.select(F.explode("vectors").alias("v")).limit(2 * sample).collect()]
    return centroids(np.array(x) if x else np.zeros((0, 1)), lists)


def build(docs: DataFrame, lists: int = LISTS, sample: int = SAMPLE, block: int = BLOCK) -> Index:
    """The index of (id long, vectors: array of arrays of one length); documents without a vector or id are left out.

    Centroids come from about ``sample`` vectors (at most twice as many) of documents drawn by
    a hash of the id; every document is indexed. Equal vectors of a block are stored once.
    """
    rows = docs.select(F.col("id").cast("long").alias("id"), F.col("vectors").cast("array<array<double>>").alias("vectors")).where("id is not null and size(vectors) > 0")
    n = rows.agg(F.sum(F.size("vectors"))).first()[0] or 0
    centers = _fitted(_drawn(rows, sample / n if n else 1.0), lists, sample)
    shared = docs.sparkSession.sparkContext.broadcast(centers)  # lists x dimension

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for whole in batches:
            sizes = np.diff(whole.column(1).offsets.to_numpy())
            cells = len(whole.column(1)[0][0]) if len(whole) else 1
            for a, b in stretches(sizes, block, CELLS // max(1, cells)):
                batch, counts = whole.slice(a, b - a), sizes[a:b]
                v = batch.column(1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(int(counts.sum()), -1)
                x, tokens = np.unique(v, axis=0, return_inverse=True)
                yield _record(k, batch.column(0), counts, tokens.ravel(), x, shared.value)
                k += 1

    bounded_batches(docs)
    return Index(cut(rows.mapInArrow(pack, BLOCK_SCHEMA), FEW), centers)


def build_texts(docs: DataFrame, lists: int = LISTS, sample: int = SAMPLE, block: int = BLOCK, dims: int = DIMS) -> Index:
    """The index of the words of (id long, content), as ``build`` of ``word_vectors`` makes it, in one pass over the texts.

    The sample takes documents of about 100 words to be the usual.
    """
    rows = docs.select(F.col("id").cast("long").alias("id"), "content").where("id is not null")
    n = rows.count()
    centers = _fitted(word_vectors(_drawn(rows, sample / 100 / n if n else 1.0), dims=dims), lists, sample)
    shared = docs.sparkSession.sparkContext.broadcast(centers)  # lists x dimension

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, k = Hashing(dims), 0
        for whole in batches:
            for a, b in stretches(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), block, TEXT):
                batch = whole.slice(a, b - a)
                found = [words_of(t) for t in batch.column(1).to_pylist()]
                number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in found for w in ws))}
                raw = model(list(number))
                there = (raw != 0).any(axis=1)
                place = np.where(there, np.cumsum(there) - 1, -1)
                kept = [[p for w in ws if (p := place[number[w]]) >= 0] for ws in found]
                some = [i for i, t in enumerate(kept) if t]
                if some:
                    tokens = np.array([p for i in some for p in kept[i]])
                    yield _record(k, batch.column(0).take(pa.array(some)), np.array([len(kept[i]) for i in some]), tokens, raw[there], shared.value)
                    k += 1

    bounded_batches(docs)
    return Index(cut(rows.mapInArrow(pack, BLOCK_SCHEMA), FEW), centers)


def bounded_batches(df: DataFrame, most: int = 32 << 20) -> None:
    """Rows of this module are megabytes each, so batches of them are bounded by bytes unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.conf.get(name, None) or int(df.sparkSession.conf.get(name)) > 1 << 30:
        df.sparkSession.conf.set(name, str(most))


def nearest(q: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    """For each vector of a query the lists nearest to it."""
    sims = q @ centers.T
    return np.argpartition(-sims, min(probes, sims.shape[1]) - 1, axis=1)[:, :probes]


def grouped(refs: list[np.ndarray], most: int) -> Iterator[tuple[range, np.ndarray]]:
    """Queries in a row that name at most ``most`` vectors together (one query may name more), and those vectors."""
    first, held = 0, np.zeros(0, np.int64)
    for i, r in enumerate(refs):
        more = np.union1d(held, r)
        if len(more) > most and i > first:
            yield range(first, i), held
            first, more = i, np.unique(r)
        held = more
    if len(refs) > first:
        yield range(first, len(refs)), held


class Best:
    """The best ``k`` documents of those seen, for each of ``n`` queries: by score rounded to nine digits, then by id."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores, self.least = k, [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n, np.full(n, -np.inf)

    def see(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        score = np.round(score, 9) + 0.0
        if len(self.ids[i]) == self.k:
            at = np.flatnonzero(score >= self.scores[i][-1])
        elif len(score) > self.k:  # equals of the k-th best are looked at too
            at = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])
        else:
            at = np.arange(len(score))
        if len(at):
            ids, score = np.concatenate([self.ids[i], ids[at]]), np.concatenate([self.scores[i], score[at]])
            top = np.lexsort((ids, -score))[: self.k]
            self.ids[i], self.scores[i] = ids[top], score[top]
            if len(top) == self.k:
                self.least[i] = score[top[-1]]


def best_products(own: np.ndarray, docs: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """Vectors of queries x documents: the best product of each with a vector of the document; own: vectors, docs: which of them each document has."""
    out = np.empty((len(q), len(docs)))
    for a in range(0, len(q), WORDS):
        sims = own @ q[a : a + WORDS].T
        for d, mine in enumerate(docs):
            out[a : a + WORDS, d] = sims[mine].max(axis=0)
    return out


@dataclass
class Part:
    """Documents of joined blocks: ids, docs (which of the vectors each has), x (vectors, distinct), size (their lengths; 1 unless they are scaled when read), longest (of the vectors as they count), lists (the centroid of each)."""

    ids: np.ndarray
    docs: list[np.ndarray]
    x: np.ndarray
    size: np.ndarray
    longest: float
    lists: np.ndarray

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Some of the vectors, as they count."""
        return self.x[which].astype(np.float64) / self.size[which, None]

    def rough(self, which: np.ndarray) -> np.ndarray:
        """The same in single precision, of length 1 at most."""
        out = self.x[which].astype(np.float32)
        out *= (1 / (self.size[which] * self.longest)).astype(np.float32)[:, None]
        return out

    def score(self, d: int, q: np.ndarray, near: np.ndarray) -> float:
        """The score of a document for vectors q, which are ``near`` in single precision at length 1: products that may be the best ones are taken again."""
        sims = self.rough(self.docs[d]) @ near.T
        best = np.flatnonzero((sims >= sims.max(axis=0) - 1e-4).any(axis=1))
        return float((self.rows(self.docs[d][best]) @ q.T).max(axis=0).sum())


def _join(held: list[tuple[np.ndarray, ...]]) -> Part:
    ids, counts, tokens, x, lists = zip(*held)
    first = np.cumsum([0, *map(len, x)])
    tokens = np.concatenate([t + f for t, f in zip(tokens, first)])
    ids, counts, x, lists = np.concatenate(ids), np.concatenate(counts), np.concatenate(x), np.concatenate(lists)
    if len(held) > 1:  # equal vectors of several blocks are one
        coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(x)]).dictionary_encode()
        place = coded.indices.to_numpy()
        n = len(coded.dictionary)
        own, near = np.empty((n, x.shape[1]), x.dtype), np.empty(n, lists.dtype)
        own[place], near[place] = x, lists
        tokens, x, lists = place[tokens], own, near
    norm = np.concatenate([np.sqrt(np.square(x[a : a + PANEL].astype(np.float64)).sum(axis=1)) for a in range(0, len(x), PANEL)])
    if x.dtype == np.float64:
        size, longest = np.ones(len(x)), float(norm.max()) or 1.0
    else:
        size, longest = np.where(norm > 0, norm, 1), 1.0
    return Part(ids, np.split(tokens, np.cumsum(counts)[:-1]), x, size, longest, lists)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Blocks of a partition, as many together as ``JOINED`` documents and ``VECTORS`` vectors allow."""
    held, n, vectors = [], 0, 0
    for batch in batches:
        for i in range(len(batch)):
            ids, (counts, tokens, x, kind, lists) = batch.column(0)[i].values.to_numpy(), (batch.column(c)[i].as_py() for c in range(1, 6))
            counts, tokens, lists = (np.frombuffer(v, np.int32) for v in (counts, tokens, lists))
            if held and (n + len(ids) > JOINED or vectors + len(tokens) > VECTORS):
                full, held, n, vectors = [held], [], 0, 0
                yield _join(full.pop())  # blocks are let go of while their part is worked on
            held.append((ids, counts, tokens, np.frombuffer(x, kind).reshape(len(lists), -1), lists))
            n, vectors = n + len(ids), vectors + len(tokens)
    if full := [held] if held else []:
        held = None
        yield _join(full.pop())


def panels(n: int, m: int, near: np.ndarray | None, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors of queries, of ``n``; vectors of documents, of ``m``) to compare: all, or those of the lists ``near`` to a query's vector."""
    pairs = [(np.arange(n), np.arange(m))]
    if near is not None:
        asked, own = np.argsort(near, axis=None, kind="stable"), np.argsort(lists, kind="stable")
        which = np.intersect1d(near, lists)
        cuts = [np.searchsorted(v.ravel()[o], which, side) for v, o in ((near, asked), (lists, own)) for side in ("left", "right")]
        pairs = ((asked[a:b] // near.shape[1], own[c:d]) for a, b, c, d in zip(*cuts))
    for qs, xs in pairs:
        for b in range(0, len(xs), PANEL):
            yield qs, xs[b : b + PANEL]


def bounds(q: np.ndarray, part: Part, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Vectors of queries x documents: steps that the best product of the two does not exceed, as far as it is among the pairs; q is of length 1 at most."""
    n, tokens = len(part.docs), np.concatenate(part.docs).astype(np.int32)
    order = np.argsort(tokens, kind="stable")
    ends = np.searchsorted(tokens[order], np.arange(len(part.x) + 1, dtype=np.int32))
    of = np.repeat(np.arange(n, dtype=np.int32), [len(d) for d in part.docs])[order]  # documents with vector v: of[ends[v] : ends[v + 1]]
    del tokens, order
    least = int(np.ceil(NEAR * STEPS + 1e-2))  # a hundredth of a step is more than single precision errs
    out, room = np.full(len(q) * n, least, np.uint8), np.empty(WORDS * PANEL, np.float32)
    for every, xs in pairs:
        x, first, count = part.rough(xs).T, ends[xs], ends[xs + 1] - ends[xs]
        for a in range(0, len(every), WORDS):
            qs = every[a : a + WORDS]
            size = len(qs) * len(xs)
            sims = room[: -(-size // 8) * 8]
            np.matmul(q[qs], x, out=sims[:size].reshape(len(qs), len(xs)))
            sims[size:] = -1
            there = sims >= NEAR
            at = (np.flatnonzero(there.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()  # few are, so eight are looked at together
            at = at[there[at]]
            at = at[np.argsort(sims[at])]  # the last one of a cell stays
            step, (row, v) = np.ceil(sims[at] * STEPS + 1e-2).astype(np.uint8), np.divmod(at, len(xs))
            row, start, many = qs[row] * n, first[v], count[v]
            for b, c in stretches(many, len(many), NOTED):
                k = many[b:c]
                place = np.repeat(start[b:c] - np.cumsum(k) + k, k) + np.arange(k.sum())
                cell = np.repeat(row[b:c], k) + of[place]
                out[cell] = np.maximum(out[cell], np.repeat(step[b:c], k))
    return out.reshape(len(q), n)


def settle(kept: Best, n: int, part: Part, q: np.ndarray, near: np.ndarray, bound: np.ndarray, most: int) -> bool:
    """Scores documents for query ``n`` (vectors q, ``near`` in single precision) from the highest bound on until none can be among the best; whether ``most`` were enough."""
    bound = bound * (1 + 1e-5) + 1e-8
    at = np.flatnonzero(bound >= kept.least[n])
    at, done = at[np.argsort(-bound[at], kind="stable")], 0
    while done < len(at) and bound[at[done]] >= kept.least[n]:
        if done >= most:
            return False
        some = at[done : done + max(1, kept.k - len(kept.ids[n]))]
        kept.see(n, part.ids[some], np.array([part.score(d, q, near) for d in some]))
        done += len(some)
    return True


def score_all(kept: Best, which: list[int], part: Part, asked: np.ndarray, refs: list[np.ndarray]) -> None:
    """Scores all documents for some queries; each vector that several queries share is compared once."""
    for some, named in grouped([refs[n] for n in which], GROUP):
        for a in range(0, len(part.docs), BLOCK):
            docs = part.docs[a : a + BLOCK]
            used, place = np.unique(np.concatenate(docs), return_inverse=True)
            products = best_products(part.rows(used), np.split(place.ravel(), np.cumsum([len(d) for d in docs])[:-1]), asked[named])
            for i in some:
                kept.see(which[i], part.ids[a : a + BLOCK], products[np.searchsorted(named, refs[which[i]])].sum(axis=0))


def answer(kept: Best, part: Part, asked: np.ndarray, refs: list[np.ndarray], lists: np.ndarray | None, candidates: int | None) -> None:
    """Sees the best documents of joined blocks for all queries; lists: those that each of the vectors ``asked`` looks at, all if None."""
    norm = np.sqrt(np.square(asked).sum(axis=1))
    most = SINGLE if lists is None else candidates * -(-len(part.ids) // BLOCK)
    for some, named in grouped(refs, GROUP):
        near = (asked[named] / np.where(norm[named] > 0, norm[named], 1)[:, None]).astype(np.float32)
        held = bounds(near, part, panels(len(near), len(part.x), None if lists is None else lists[named], part.lists))
        scale, left = (norm[named] * part.longest / STEPS).astype(np.float32), []
        for n in some:
            mine, before = np.searchsorted(named, refs[n]), (kept.ids[n], kept.scores[n], kept.least[n])
            if not settle(kept, n, part, asked[refs[n]], near[mine], scale[mine] @ held[mine], most) and lists is None:
                kept.ids[n], kept.scores[n], kept.least[n] = before  # all are seen below
                left.append(n)
        del held
        score_all(kept, left, part, asked, refs)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = PROBES, candidates: int | None = CANDIDATES, most: int = ASKED) -> DataFrame:
    """(qid, rank, id, score): the best ``k`` documents for each query (qid, vectors) by the sum of best matches.

    Queries go to the workers about ``most`` vectors at a time (32 MB at 64 numbers each), and
    tasks run through the blocks with them; blocks are not moved. Every document gets a bound
    of its score, and documents are scored from the highest bound on, until none can be among
    the best any more. With ``candidates`` the bound comes from the ``probes`` lists nearest to
    a vector, so a document may be missed whose near vectors lie in other lists, and at most
    so many documents of 1,024 are scored a query; None compares all vectors and misses none.
    Scores are rounded to nine digits, ties go to the smaller id. Queries without a vector find
    nothing; a null qid is a query. A task keeps the best ``k`` a query, and the bests of the
    tasks are merged by a window that Spark cuts before it shuffles.
    """
    kind = dict(queries.dtypes)["qid"]
    asked = cut(queries.select("qid", F.col("vectors").cast("array<array<double>>").alias("vectors")).where("size(vectors) > 0"))
    turns = max(1, -(-(asked.agg(F.sum(F.size("vectors"))).first()[0] or 0) // most))
    part, spark, found = F.pmod(F.xxhash64("qid"), F.lit(turns)), queries.sparkSession, None
    bounded_batches(queries)
    # each task finds its best documents for every query, so as few as keep all cores busy
    blocks = index.blocks.select("ids", "counts", "tokens", "x", "kind", "lists").coalesce(spark.sparkContext.defaultParallelism)
    for turn in range(turns):
        mine = (asked.where(part == turn) if turns > 1 else asked).toArrow().combine_chunks()
        vectors = mine.column("vectors").combine_chunks()
        count = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().flatten().to_numpy(zero_copy_only=False).reshape(int(count.sum()), -1) if len(mine) else np.zeros((0, 1))
        x, refs = np.unique(flat, axis=0, return_inverse=True)
        shared = spark.sparkContext.broadcast((index.centers, mine.column("qid").to_pylist(), x, np.split(refs.ravel(), np.cumsum(count)[:-1]) if len(mine) else []))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            centers, qids, asked, refs = shared.value
            if not qids:
                return
            give_back()  # what the index was built with
            kept, lists_of = Best(len(qids), k), None
            for own in joined(batches):
                exact = candidates is None or candidates * -(-len(own.ids) // BLOCK) >= len(own.ids)
                if not exact and lists_of is None:
                    lists_of = np.concatenate([nearest(asked[a : a + PANEL], centers, probes) for a in range(0, len(asked), PANEL)]).astype(np.int32)
                answer(kept, own, asked, refs, None if exact else lists_of, candidates)
                del own  # before the next blocks are joined
            size = [len(f) for f in kept.ids]
            rows = [pa.array([q for q, n in zip(qids, size) for _ in range(n)], names), pa.array(np.concatenate(kept.ids)), pa.array(np.concatenate(kept.scores))]
            yield pa.RecordBatch.from_arrays(rows, names=["qid", "id", "score"])

        names = mine.schema.field("qid").type
        own = blocks.mapInArrow(best, f"qid {kind}, id long, score double")
        found = own if found is None else found.unionByName(own)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")
