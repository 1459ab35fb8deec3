import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("x", "code", "ids", "error", "_of", "sums")}).repartition(3)


def expected(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds in Python's whole numbers, measuring everything each time."""
    kept = [(i, [int(np.floor(4096 * float(np.float32(c)))) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes) if code[p] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(far(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    by_label = defaultdict(int)
    for (_, _, lab), err in zip(kept, errors):
        by_label[lab] += err
    return Counter((i, "".join(f"{e:02x}" for e in code), err, by_label[lab], digest) for (i, _, lab), code, err in zip(kept, codes, errors))


def check(spark, rows, block):
    assert Counter(tuple(r) for r in vectorcodes.encode(table(spark, rows), block=block).collect()) == expected(rows)


@pytest.mark.parametrize("block", [7, 4096])
def test_equals_plain_rounds(spark, block):
    rng = np.random.default_rng(block)
    e = (rng.normal(size=(230, 16)) * 0.3 + rng.integers(0, 3, (230, 1))).astype(np.float32)
    check(spark, [(k, v.tolist(), k % 5 if k % 7 else None) for k, v in enumerate(e)], block)


def test_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    e = rng.integers(0, 2, (150, 16)) / 4096  # few distinct parts: entries coincide and distances tie
    check(spark, [(k // 3, v.tolist(), 1) for k, v in enumerate(e)] + [(1, e[3].tolist(), 1)] * 40, 16)


def test_nulls_and_fewer_vectors_than_entries(spark):
    rows = [(3, [0.5] * 8, 1), (1, [0.25] * 8, None), (None, [-0.1] * 8, None), (9, None, 1), (8, [None] * 8, 1), (7, [float("nan")] * 8, 2), (6, [float("inf")] * 8, 2)]
    check(spark, rows, 4096)
    check(spark, [(1, [1.0] * 8, 2)], 4096)


def test_bounds_spare_work_and_stay_exact():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(3000, 2, 4)) * 300 + rng.integers(0, 16, (3000, 1, 1)) * 2000).astype(np.int32)
    books = x[:16].astype(np.int64).swapaxes(0, 1)
    drift, block, seen = np.zeros(books.shape[:2]), vectorcodes.Block.start(x, books), []
    for _ in range(12):
        books, drift = vectorcodes.next_books(block.sums, books, drift)
        seen.append(block.assign(books, drift))
        for p in range(2):
            assert (block.codes()[:, p] == vectorcodes.nearest(x[:, p].astype(np.int64), books[p])[0]).all()
    assert seen[-1] < 600 < seen[0] <= 6000


def test_an_empty_table(spark):
    got = vectorcodes.encode(table(spark, []))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


def test_wrong_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="cannot be cut"):
        vectorcodes.encode(table(spark, [(1, [1.0] * 9, 1)]))
    with pytest.raises(Exception, match="vectors of 8 and of 16"):
        vectorcodes.encode(table(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])).collect()
