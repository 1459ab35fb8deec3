"""Embeddings of texts without a model service, and exact nearest neighbours.

The hashing embedder counts a text's words and the character trigrams of each word, marked at
both ends, in ``dims`` cells: MD5 chooses cell and sign of a feature. Counts are whole
numbers, so equal texts get equal vectors on every machine; they are scaled to length 1
beside the model. Any other model that turns a list of texts into rows of numbers can take
its place.

Texts are embedded once for each content hash and joined back to all rows that hold them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.text import script_language
from siltstone.storage import cut

DIMS, GRAM = 256, 3
#: Words and trigrams whose hashes a worker keeps, about 200 bytes each.
CACHE_WORDS = 300_000
#: Rows of one block when vectors are compared.
BLOCK = 1024
Model = Callable[[list[str]], np.ndarray]
#: Models by provider; the last two are those for Russian texts (fixed values).
MODELS = {"openai": "text-embedding-3-small", "qwen": "text-embedding-v3", "ollama": "nomic-embed-text"}
#: Stands between texts that are searched for words together.
MARK = "\0"
#: Places of words that are counted at a time.
STRETCH = 65_536
_words = regex.compile(r"[\p{L}\p{N}]+|\0").findall
#: The same, faster, for texts without characters from U+0500 on; beyond, the classes of the two modules differ.
_near_words, _beyond = re.compile(r"[^\W_]+|\0").findall, re.compile("[\u0500-\U0010ffff]").search


def words_of(text: str | None) -> list[str]:
    """The distinct words of a text in order of first use."""
    return [w for w in dict.fromkeys(_words((text or "").lower())) if w != MARK]


def features(word: str) -> list[str]:
    """A word and its trigrams, between marks of its ends."""
    marked = f"<{word}>"
    return [marked, *(marked[i : i + GRAM] for i in range(len(word)))]


class _Numbers(dict):
    """Words and their numbers, in order of first use from 0 on; the mark is -1."""

    def __init__(self):
        super().__init__({MARK: -1})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) - 1
        self.new.append(word)
        return n


class Hashing:
    """The hashing embedder: a list of texts to rows of whole numbers.

    Of each word only the places that it counts in are kept, some eight of ``2 * dims``: a
    feature counts up in one half or down in the other.
    """

    def __init__(self, dims: int = DIMS):
        self.dims = dims
        self._forget()

    def _forget(self) -> None:
        # places of word n: self.places[self.ends[n] : self.ends[n + 1]]
        self.known, self.cells, self.count = _Numbers(), {}, 0
        self.ends, self.places = np.zeros(8192, np.int64), np.zeros(65_536, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Places of new words: the hashes of their trigrams are looked up all at once."""
        n, dims, md5 = len(words), np.uint64(self.dims), hashlib.md5
        place = lambda digests: ((h := np.frombuffer(b"".join(digests), ">u8") >> np.uint64(4)) % dims + h // dims % np.uint64(2) * dims).astype(np.int32)
        size = np.fromiter(map(len, words), np.int64, n)
        points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        own = np.cumsum(size + 1) - 1  # where a word's own place goes, behind those of its trigrams
        at = np.delete(np.arange(size.sum() + n), own)
        start = at + np.repeat(np.arange(n), size)  # a word has two marks among the points
        codes = (points[start] << np.uint64(42)) | (points[start + 1] << np.uint64(21)) | points[start + 2]
        kinds, of = np.unique(codes, return_inverse=True)
        kinds = kinds.tolist()
        if new := [c for c in kinds if c not in self.cells]:
            self.cells.update(zip(new, place([md5((chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF)).encode()).digest()[:8] for c in new]).tolist()))
        first = int(self.ends[self.count])
        last = first + int(size.sum()) + n
        while last > len(self.places):
            self.places = np.concatenate([self.places, np.zeros_like(self.places)])
        while self.count + n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.places[first + at] = np.fromiter(map(self.cells.__getitem__, kinds), np.int32, len(kinds))[of]
        self.places[first + own] = place([md5(f"<{w}>".encode()).digest()[:8] for w in words])
        self.ends[self.count + 1 : self.count + n + 1] = first + own + 1
        self.count += n

    def _sums(self, ids: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """The rows of ``n`` texts from the numbers of all words and those of the texts that they stand in, which rise."""
        out, two = np.zeros((n, self.dims), np.int32), 2 * self.dims
        first = self.ends[ids]
        size = self.ends[ids + 1] - first
        upto = np.cumsum(size)
        a, done = 0, 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(upto, done + STRETCH, "right")))
            low, high, k = int(text[a]), int(text[b - 1]) + 1, size[a:b]
            at = np.repeat(first[a:b] - (upto[a:b] - k - done), k)
            at += np.arange(len(at))
            found = np.repeat((text[a:b] - low) * two, k)
            found += self.places[at]
            counts = np.bincount(found, minlength=(high - low) * two).reshape(-1, 2, self.dims)
            out[low:high] += counts[:, 0] - counts[:, 1]
            a, done = b, int(upto[b - 1])
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros((0, self.dims), np.int32)]
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            if len(self.known) + len(self.cells) > CACHE_WORDS or self.ends[self.count] > 16 * CACHE_WORDS:
                self._forget()
            whole = MARK.join(part).lower()
            if whole.count(MARK) != len(part) - 1:
                whole = MARK.join(t.replace(MARK, " ") for t in part).lower()
            found = (_words if _beyond(whole) else _near_words)(whole)
            ids = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
            new, self.known.new = self.known.new, []
            for k in range(0, len(new), 4096):
                self._learn(new[k : k + 4096])
            mark = ids < 0
            real = np.flatnonzero(~mark)
            out.append(self._sums(ids[real], np.cumsum(mark)[real], len(part)))
        return np.concatenate(out)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; those of length 0 stay."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def vectors(text: Column, make: Callable[[], Model] = Hashing, unit: bool = False) -> Column:
    """The model's numbers for each text, null as empty, at length 1 if ``unit``; ``make`` builds the model once a worker and task."""

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in batches:
            parts = [np.asarray(model(texts.slice(a, 256).to_pylist())).astype(np.float64) for a in range(0, len(texts), 256)]
            parts = [scaled(x) for x in parts] if unit else parts
            dims = parts[0].shape[1] if parts else 0
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dims, pa.int32()), pa.array(np.concatenate([np.zeros(0), *map(np.ravel, parts)])))

    return embed(F.coalesce(text, F.lit("")))


def embed_rows(rows: DataFrame, text: str = "content", make: Callable[[], Model] = Hashing, vector: str = "embedding") -> DataFrame:
    """All rows with ``text_hash`` (SHA-256; null counts as empty) and the vector of their text, of length 1.

    Distinct texts go through the model once. Both columns replace others of these names;
    repeated rows stay as often as they stand, and an empty table gives an empty one.
    """
    rows = rows.drop("text_hash", vector).withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    once = rows.select("text_hash", F.coalesce(F.col(text), F.lit("")).alias("_t")).dropDuplicates(["text_hash"])
    made = cut(once.select("text_hash", vectors(F.col("_t"), make, unit=True).alias(vector)))
    return rows.join(made, "text_hash").select(*(c for c in rows.columns if c != "text_hash"), "text_hash", vector)


def model_name(text: Column, provider: str = "openai") -> Column:
    """The model that a provider has for the language of a text."""
    russian = {"qwen": MODELS["qwen"], "ollama": MODELS["ollama"]}.get(provider, MODELS["openai"])
    return F.when(script_language(text) == "ru", russian).otherwise(MODELS.get(provider, MODELS["openai"]))


def embed_chunks(chunks: DataFrame, provider: str = "openai", make: Callable[[], Model] = Hashing) -> DataFrame:
    """Chunks (content and more) with ``embedding``, ``provider`` and ``model``."""
    return embed_rows(chunks, "content", make).withColumns({"provider": F.lit(provider), "model": model_name(F.col("content"), provider)})


def points(chunks: DataFrame, source_tag: str = "default", entities: DataFrame | None = None) -> DataFrame:
    """Rows of a vector sink (id, vector, payload) from embedded chunks (chunk_id, source_id, chunk_index, content, embedding).

    ``entities`` (source_id, chunk_index, entities: array<string>) are paired by their place;
    chunks without a pair are then left out, as places beyond the shorter list are.
    """
    payload = [F.lit("source_tag"), F.lit(source_tag), F.lit("source_id"), F.col("source_id"), F.lit("content"), F.col("content"), F.lit("chunk_index"), F.col("chunk_index").cast("string")]
    if entities is not None:
        chunks = chunks.join(entities.select("source_id", "chunk_index", "entities"), ["source_id", "chunk_index"])
        payload += [F.lit("entities"), F.array_join("entities", "|")]
    return chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"), F.create_map(*payload).alias("payload"))


def as_matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a batch of (id, embedding); vectors must have one length."""
    return batch.column(0).to_numpy(), scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1))


class Best:
    """The best ``k`` of all rows seen, for each query: by score rounded to nine digits, then by id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.x, self.rough, self.k = queries, queries.astype(np.float32), k
        self.found: list[list[tuple[float, int]]] = [[] for _ in queries]
        self.least = np.full(len(queries), -np.inf)

    def see(self, ids: np.ndarray, rows: np.ndarray, size: int) -> None:
        """All products are taken in single precision; those that may be among the best by its bound of error are taken again."""
        near, slack = rows.astype(np.float32).T, (rows.shape[1] + 4) * 2.0**-24 + 1e-9
        for a in range(0, len(self.x), size):
            score = self.rough[a : a + size] @ near
            top = score.max(axis=1) >= self.least[a : a + size] - slack
            for q in np.flatnonzero(top):
                own = score[q]
                least = self.least[a + q] - slack
                if len(own) > self.k:  # equals of the k-th best are looked at too
                    least = max(least, float(np.partition(own, len(own) - self.k)[len(own) - self.k]) - 2 * slack)
                at = np.flatnonzero(own >= least)
                exact = np.round(rows[at] @ self.x[a + q], 9) + 0.0
                merged = sorted([*self.found[a + q], *zip((0.0 - exact).tolist(), ids[at].tolist())])[: self.k]
                self.found[a + q] = merged
                if len(merged) == self.k:
                    self.least[a + q] = -merged[-1][0]


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, size: int = BLOCK, most: int = 32_768, stored: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows of every query by cosine, exactly; both have (id, embedding).

    Queries go to the workers ``most`` at a time (64 MB at 256 numbers each), and every task
    runs once through its rows with them in blocks of ``size``; rows are not moved. A task keeps
    the best ``k`` a query, and the bests are merged by a window that Spark cuts to ``k`` before
    it shuffles. Scores are rounded to nine digits and ties go to the smaller id. A query finds
    itself if it is among the rows. Null ids and empty vectors are left out; repeated rows are
    found as often as they stand, repeated queries must not be. Rows that are read more than
    once are written first, unless they are ``stored`` as they are.
    """
    from pyspark.sql import Window

    fine = lambda d: d.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and size(embedding) > 0")
    asked, held, spark = cut(fine(queries)), fine(rows), rows.sparkSession
    held = held.coalesce(2 * spark.sparkContext.defaultParallelism)  # each task answers every query, so as few as keep all cores busy
    n = asked.count()
    turns = max(1, -(-n // most))
    # a turn is a range of the hash of ids, so that it has about as many queries as the others
    part = F.pmod(F.xxhash64("id"), F.lit(turns))
    held = cut(held).coalesce(2 * spark.sparkContext.defaultParallelism) if turns > 1 and not stored else held
    found = None
    for turn in range(turns):
        mine = (asked.where(part == turn) if turns > 1 else asked).toArrow()
        batch = mine.combine_chunks().to_batches()[0] if len(mine) else None
        shared = spark.sparkContext.broadcast(as_matrix(batch) if batch is not None else (np.zeros(0, np.int64), np.zeros((0, 1))))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, x = shared.value
            if not len(names):
                return
            kept = Best(x, k)
            for whole in batches:
                for a in range(0, len(whole), size):
                    kept.see(*as_matrix(whole.slice(a, size)), size)
            count = [len(f) for f in kept.found]
            every = [f for fs in kept.found for f in fs]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, count)), pa.array([i for _, i in every], pa.int64()), pa.array([0.0 - s for s, _ in every], pa.float64())], names=["query_id", "id", "score"])

        own = held.mapInArrow(best, "query_id long, id long, score double")
        found = own if found is None else found.unionByName(own)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
