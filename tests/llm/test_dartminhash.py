import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import dartminhash as dm


def brute_classes(rows, least=dm.LEAST, weight="set"):
    """Smallest doc_id of each component of the graph of similar texts."""
    known = dm.WordHashes()
    sets = [Counter(dm.shingle_hashes(t or "", dm.WORDS, known).tolist()) for _, t in rows]
    if weight == "set":
        sets = [Counter(s.keys()) for s in sets]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a & b).total() >= least * (a | b).total():
                root[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        low[r] = min([x for x in (low.get(r), d) if x is not None], default=None)
    return sorted(((d, low[find(k)]) for k, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed, base_words=60, groups=6, each=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(base_words)]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("weight", ["set", "count"])
def test_coordinates_agree_as_often_as_the_sets_are_similar(weight):
    rng = np.random.default_rng(5)
    u = rng.integers(0, 2**63, 600).astype(np.uint64)
    wa, wb = (np.ones(400), np.ones(400)) if weight == "set" else (rng.random(400) * 4 + 0.01, rng.random(400) * 4 + 0.01)
    a, b = (u[:400], wa), (u[100:500], wb)
    got = dm.signatures([a, b], 4000)
    order = lambda s: (np.sort(s[0]), s[1][np.argsort(s[0])])
    assert abs((got[0] == got[1]).mean() - dm.similarity(order(a), order(b))) < 0.035


def test_signatures_do_not_depend_on_company_or_order():
    rng = np.random.default_rng(6)
    sets = [(rng.integers(0, 2**63, n).astype(np.uint64), np.ones(n)) for n in (1, 7, 300)]
    alone = [dm.signatures([s])[0] for s in sets]
    together = dm.signatures([*reversed(sets), (np.zeros(0, np.uint64), np.zeros(0))])
    assert (together[:3] == np.array(alone[::-1])).all() and not together[3].any()


def test_classes_equal_brute_force(spark):
    rows = near_copies(1) + [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two!"), (None, "one two"), (1004, "w " * 3000), (5, "again another text of more than five words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = sorted(((r["doc_id"], r["class_id"]) for r in dm.near_duplicates(df).collect()), key=repr)
    assert got == brute_classes(rows)


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(dm, "BLOCK", 5)
    rows = near_copies(2, groups=2, each=40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in dm.near_duplicates(df).collect()), key=repr)
    assert got == brute_classes(rows)


def test_repeats_weigh_in_the_query(spark):
    """Texts with the same shingles, repeated differently, are apart by count only; a row repeated whole is one document."""
    body = " ".join(f"w{k}" for k in range(40))
    rows = near_copies(3, groups=2) + [(900, body), (901, body + " " + " ".join([" ".join(f"w{k}" for k in range(12))] * 30)), (902, body + " x"), (902, body + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in dm.near_duplicates(df, weight="count").collect()), key=repr)
    assert got == brute_classes(rows, weight="count") and (901, 901) in got and got.count((902, 900)) == 2
    assert sorted(r["doc_id"] for r in dm.keep_one(df, weight="count").collect()) == sorted({c for _, c in got})


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dm.near_duplicates(empty).count() == 0 and dm.keep_one(empty).count() == 0
