"""Near-duplicate detection with DartMinHash.

Darts are thrown, by hashes of the element alone, at each element's region of weight x rank:
a unit-rate Poisson process. A dart of rank r and height h counts if h is within the
element's weight; it falls on one of K coordinates, and a coordinate keeps its earliest
dart. Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity. A document needs about K ln K darts however long it is, since ranks beyond
K (ln K + c) / total weight are never looked at.

Elements are five-word shingles; ``weight`` is 1 (sets) or their count, as the query has it.
Documents with equal shingles and weights form one class; classes that share a band are
candidates. Candidates are first linked through the most central member of each band's
bucket and verified on whole texts; for buckets whose members are then still in different
components all pairs between components are estimated from the signatures, in blocks, and
those that may reach the threshold verified there. A pair in one component needs no link of its own. A link between components is lost if its
pair shares no band or is estimated too low: at similarity 0.8 with a probability of 4e-9 and
about 2e-7.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.components import components
from siltstone.llm.shared import give_back, materialise, require, text_or_empty

#: Words a shingle, least similarity, coordinates, and how bands are cut from all of them.
WORDS, LEAST, K, BANDS, ROWS = 5, 0.8, 384, 64, 6
#: Estimates this far below the threshold still count: over five standard deviations of K coordinates.
SLACK = 0.11
#: Members of a bucket that are compared in one block, the shingles that fill one, and partners that share a copy of a text.
BLOCK, BLOCK_SHINGLES, HUB = 1024, 2_000_000, 128
CACHE_WORDS = 150_000
#: Steps of rank in a unit, and a rank beyond all others.
UNIT, FAR = 2.0**32, 2**62
_G = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


def shingle_hashes(text: str, words: int, known: WordHashes) -> np.ndarray:
    """Hashes of the text's word shingles with repeats; a shorter text is one shingle, no words none."""
    found = re.findall(r"\w+", text.lower())
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out * _G + h[k : len(h) - n + 1 + k])
    return out


def elements(shingles: np.ndarray, weight: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: 1 (``set``) or how often they occur (``count``)."""
    found, times = np.unique(shingles, return_counts=True)
    return found, np.ones(len(found)) if weight == "set" else times.astype(float)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K, slack: float = 2.5) -> np.ndarray:
    """A row of ``k`` coordinates for each weighted set; sets without elements get zeros.

    Ranks are whole multiples of 1 / ``UNIT``, so sums of gaps are exact however darts are
    batched; a coordinate keeps the least rank that falls on it, which tells darts apart.
    """
    out = np.zeros((len(sets), k), np.uint64)
    todo, limit = [i for i, s in enumerate(sets) if len(s[0])], k * (np.log(k) + slack)
    while todo:
        which = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        x = np.concatenate([sets[i][0] for i in todo])
        w = np.concatenate([sets[i][1] for i in todo])
        slabs = np.ceil(w).astype(np.int64)  # unit-high slabs of each element's region
        whole = bool((slabs == w).all())
        slab = np.arange(slabs.sum()) - np.repeat(np.cumsum(slabs) - slabs, slabs)
        which, x, w = np.repeat(which, slabs), np.repeat(x, slabs), np.repeat(w, slabs)
        seed = mixed(x + mixed((slab.astype(np.uint64) + np.uint64(1)) * _G))
        reach = (limit / np.array([sets[i][1].sum() for i in todo]))[which]
        least = np.full(len(todo) * k, FAR)
        rank, thrown, at = np.zeros(len(x), np.int64), np.zeros(len(x), np.uint64), np.arange(len(x))
        end = (reach * UNIT).astype(np.int64)
        times = np.where(reach < 1, 1, reach + np.sqrt(reach)).astype(np.int64)
        while len(at):  # as many darts of every region as it is likely to need still
            stop = np.cumsum(times)
            region = np.repeat(at, times)
            number = np.arange(1, stop[-1] + 1) - np.repeat(stop - times, times)
            dart = mixed(seed[region] + (thrown[region] + number.astype(np.uint64)) * _G)
            gap = (np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) * -UNIT).astype(np.int64)
            when = np.cumsum(gap)
            when += np.repeat(rank[at] - (when[stop - times] - gap[stop - times]), times)
            rank[at], thrown[at] = when[stop - 1], thrown[at] + times.astype(np.uint64)
            hit = when <= end[region]
            region, dart, when = region[hit], dart[hit], when[hit]
            where = mixed(dart ^ _G)
            if not whole:
                inside = slab[region] + ((where >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32 <= w[region]
                region, where, when = region[inside], where[inside], when[inside]
            np.minimum.at(least, which[region] * k + (where & np.uint64(0xFFFFFFFF)).astype(np.int64) % k, when)
            at = at[rank[at] <= end[at]]
            left = (end[at] - rank[at]) / UNIT
            times = (left + 2 * np.sqrt(left)).astype(np.int64) + 1
        least = least.reshape(len(todo), k)
        filled = (least < FAR).all(axis=1)
        out[[i for i, ok in zip(todo, filled) if ok]] = mixed(least[filled].view(np.uint64)) | np.uint64(1)
        todo, limit = [i for i, ok in zip(todo, filled) if not ok], limit * 2
    return out


def sign(docs: DataFrame, words: int = WORDS, weight: str = "set", k: int = K) -> DataFrame:
    """(id, doc_id, same, n, total, sig): a digest of the weighted shingles, their number and weight, and a byte a coordinate. docs: id, doc_id (longs), text."""
    schema = "id long, doc_id long, same binary, n long, total double, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for a in range(0, len(whole), 64):
                batch = whole.slice(a, 64)
                sets = [elements(shingle_hashes(t.as_py(), words, known), weight) for t in batch.column(2)]
                sigs = (signatures(sets, k) >> np.uint64(8)).astype(np.uint8)
                same = [xxhash.xxh3_128_digest(s.tobytes() + w.tobytes()) for s, w in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array([len(s) for s, _ in sets], pa.int64()), pa.array([w.sum() for _, w in sets], pa.float64()), pa.array([s.tobytes() for s in sigs], pa.binary())], names=["id", "doc_id", "same", "n", "total", "sig"])
                if len(known) > CACHE_WORDS:
                    known.clear()
        known.clear()
        give_back()

    return docs.mapInArrow(run, schema)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 1.0


def verify(pairs: DataFrame, texts: DataFrame, words: int, weight: str, least: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose whole texts are similar; texts: id, text, one row an id.

    The partners of one ``a`` are dealt in parts of about ``HUB``, each behind one copy of its
    text; a worker holds the shingles of one ``a`` and of one partner at a time.
    """
    kind = pairs.schema[0].dataType.simpleString()
    hubs = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")), "near-hubs")
    parted = materialise(pairs.join(hubs, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")), "near-parted")
    first = hubs.join(texts, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(kind).alias("b"), "text")
    rows = first.unionByName(parted.join(texts, F.col("b") == F.col("id")).select("a", "part", "b", "text"))
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hub = WordHashes(), None
        for batch in batches:
            keep = []
            for b, text in zip(batch.column(2), batch.column(3)):
                own = elements(shingle_hashes(text.as_py(), words, known), weight)
                keep.append(b.is_valid and similarity(hub, own) >= least)
                hub = hub if b.is_valid else own
            if len(known) > CACHE_WORDS:
                known.clear()
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 2])
        known.clear()
        give_back()

    return dealt.select("a", "part", "b", "text").mapInArrow(run, f"a {kind}, b {kind}")


def blocks(left: DataFrame) -> DataFrame:
    """The rows of open buckets dealt to pairs of blocks between which roots differ; left: key, root, id, n and more.

    A block has about ``BLOCK`` members, or fewer of many shingles. A root that fills half a
    block of a bucket or more has blocks of its own, smaller ones share blocks. Two blocks of
    one root are never paired, so a member is copied once for each block of another root.
    """
    load = F.sum(1 + F.col("n") / BLOCK_SHINGLES * BLOCK)
    sizes = materialise(left.groupBy("key", "root").agg(load.alias("m")), "near-sizes")
    small = sizes.where(F.col("m") < BLOCK / 2).groupBy("key").agg(F.sum("m").alias("pooled"))
    pool, own = F.coalesce("pooled", F.lit(1)), F.col("m") >= BLOCK / 2
    part = F.when(own, F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK))).otherwise(F.pmod(F.xxhash64("root"), F.ceil(pool / BLOCK)))
    placed = left.join(sizes, ["key", "root"]).join(small, "key", "left").withColumn("of", F.when(own, F.col("root")))
    placed = materialise(placed.withColumn("block", F.xxhash64("of", part)).drop("m", "pooled"), "near-blocks")
    a = placed.select("key", "block", "of").distinct()
    b = a.select("key", F.col("block").alias("bb"), F.col("of").alias("ofb"))
    apart = F.coalesce(F.col("of") != F.col("ofb"), F.lit(True))
    pairs = materialise(a.join(b, "key").where((F.col("block") <= F.col("bb")) & apart).select("key", F.col("block").alias("ba"), "bb"), "near-block-pairs")
    placed = placed.drop("of")
    one = placed.withColumn("ba", F.col("block")).join(pairs, ["key", "ba"]).withColumn("side", F.lit(0))
    two = placed.withColumn("bb", F.col("block")).join(pairs.where("ba <> bb"), ["key", "bb"]).withColumn("side", F.lit(1))
    return one.unionByName(two).select("key", "ba", "bb", "side", "band", "id", "root", "total", "sig")


def open_pairs(g: dict[str, list], same: bool, least: float, rows_a_band: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) of one pair of blocks: partners with another root whose weights and estimates allow ``least``, likeliest first.

    A pair is looked at under the first band that it shares only.
    """
    sides = np.array(g["side"])
    left, right = (np.arange(len(sides)),) * 2 if same else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
    sig = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(sides), -1)
    bands = sig[:, : sig.shape[1] // rows_a_band * rows_a_band].reshape(len(sides), -1, rows_a_band)
    roots, total = np.array(g["root"]), np.array(g["total"])
    for i in left:
        others = right[right > i] if same else right
        others = others[(roots[others] != roots[i]) & (np.minimum(total[others], total[i]) >= least * np.maximum(total[others], total[i]))]
        agree = (sig[others] == sig[i]).mean(axis=1)
        near = (agree - 1 / 256) / (1 - 1 / 256) >= least - SLACK
        others, agree = others[near], agree[near]
        if len(others):
            first = (bands[others] == bands[i]).all(axis=2).argmax(axis=1) == g["band"][i]
            yield i, others[first][np.argsort(-agree[first], kind="stable")]


def by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key, columns) of each run of rows with equal first three columns."""
    now, group = None, {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != now:
                if now is not None:
                    yield now, group
                now, group = row[:3], {n: [] for n in names}
            for n, v in zip(names, row[3:]):
                group[n].append(v)
    if now is not None:
        yield now, group


def verified_between(left: DataFrame, texts: DataFrame, words: int, weight: str, least: float, rows_a_band: int) -> DataFrame:
    """Links (a, b) that join all roots which a similar pair of some bucket joins; left: key, band, id, root, n, total, sig.

    Block pairs are run through twice: on signatures alone, to tell who has a partner that
    may be similar, and then with the whole texts of those, where each pair is verified
    unless links of its blocks have joined it already. So links grow with the members only.
    """
    dealt = lambda rows: rows.repartition("key", "ba", "bb").sortWithinPartitions("key", "ba", "bb", "id", "band")
    place, own = ["key", "ba", "bb"], ["side", "band", "id", "root", "total", "sig"]

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, g in by_group(batches, own):
            found = np.zeros(len(g["id"]), bool)
            for i, others in open_pairs(g, key[1] == key[2], least, rows_a_band):
                found[others] = True
                found[i] |= bool(len(others))
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(at), pa.int64()) for k in key), pa.array([g["side"][i] for i in at], pa.int32()), pa.array([g["band"][i] for i in at], pa.int32()), pa.array([g["id"][i] for i in at], pa.int64()), pa.array([g["root"][i] for i in at], pa.int64()), pa.array([g["total"][i] for i in at], pa.float64()), pa.array([g["sig"][i] for i in at], pa.binary())], names=place + own)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for key, g in by_group(batches, [*own, "text"]):
            joined: dict[int, int] = {}
            sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            links = []

            def root(r: int) -> int:
                while r in joined:
                    r = joined[r]
                return r

            def of(i: int) -> tuple[np.ndarray, np.ndarray]:
                if i not in sets:
                    sets[i] = elements(shingle_hashes(g["text"][i], words, known), weight)
                return sets[i]

            for i, others in open_pairs(g, key[1] == key[2], least, rows_a_band):
                for j in others:
                    a, b = root(g["root"][i]), root(g["root"][j])
                    if a != b and similarity(of(i), of(j)) >= least:
                        joined[max(a, b)] = min(a, b)
                        links.append((g["id"][i], g["id"][j]))
            if len(known) > CACHE_WORDS:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    some = materialise(dealt(blocks(left)).mapInArrow(partnered, "key long, ba long, bb long, side int, band int, id long, root long, total double, sig binary"), "near-partnered")
    whole = some.join(texts, "id").select(*place, *own, "text")
    return dealt(whole).select(*place, *own, "text").mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = LEAST, weight: str = "set", k: int = K, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, n_shingles, row, class_row): one row per row of ``docs``; near duplicates share class_id, the smallest doc_id of the class.

    ``row`` is a hash of doc_id and text, ``class_row`` that of the row that stands for the class.
    Words are runs of letters, digits and underscores in lower case. A text of fewer words
    than ``words`` is one shingle; texts without words (null and empty too) are alike.
    doc_id is taken as a long; class_id is null if no member has one. Rows with a repeated or
    null doc_id are documents of their own. Extra columns are ignored.
    """
    require(docs, ["doc_id", "text"])
    texts = docs.select(F.xxhash64("doc_id", "text").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    signed = materialise(sign(texts, words, weight, k), "near-signed")
    reps = materialise(signed.groupBy("same").agg(F.min("id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("low")), "near-classes")
    kept = materialise(signed.join(reps.select(F.col("rep").alias("id"), F.col("same").alias("s")), "id").where("same = s").select("id", "n", "total", "sig").dropDuplicates(["id"]), "near-kept")

    shared = kept.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select("id", "band", F.xxhash64("band", F.expr(f"substring(sig, band * {rows} + 1, {rows})")).alias("key"))
    sizes = shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(shared.join(sizes, "key"), "near-members")
    central = materialise(members.groupBy("id").agg(F.sum("n").alias("score")), "near-central")
    used = materialise(texts.select("id", "text").join(central.select("id").hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "near-texts")
    members = materialise(members.drop("n").join(central, "id"), "near-members")
    leaders = members.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("m")).select("key", (-F.col("m.neg")).alias("leader"))
    stars = members.join(leaders, "key").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    links = materialise(verify(materialise(stars.distinct(), "near-stars"), used, words, weight, least), "near-links")

    roots = components(links)
    placed = materialise(members.join(roots, "id", "left").select("key", "band", "id", F.coalesce("root", "id").alias("root")), "near-placed")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = materialise(placed.join(open_keys, "key").join(kept, "id"), "near-left")
    roots = components(links.union(materialise(verified_between(left, used, words, weight, least, rows), "near-more")))
    rooted = materialise(reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("same", F.coalesce("root", "rep").alias("root"), "low"), "near-rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("low"))
    classes = materialise(rooted.drop("low").join(lowest, "root").select("same", F.col("low.doc_id").alias("class_id"), F.col("low.id").alias("class_row")), "near-class-ids")
    return signed.select("doc_id", "id", "same", "n").join(classes, "same").select("doc_id", "class_id", F.col("n").alias("n_shingles"), F.col("id").alias("row"), "class_row")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their classes, with all their columns; rows equal in doc_id and text are one document."""
    classes = near_duplicates(docs, **options).where(F.col("row") == F.col("class_row"))
    keep = materialise(classes.select(F.col("row").alias("_keep")).distinct(), "near-kept-rows")
    return docs.join(keep.hint("merge"), F.xxhash64("doc_id", "text") == F.col("_keep"), "left_semi")
