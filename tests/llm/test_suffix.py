import hashlib
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from siltstone.llm import suffix


def brute(rows, length):
    """Counts every window of every row."""
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(n) for n in (10, 30, 60, 90)]
    rows = []
    for i in range(80):
        parts = [text(rng.randint(0, 60)) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts.insert(rng.randint(0, len(parts)), s[a:])
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, "x" * 700), (103, "ab" * 300), (104, None), (105, ""), (None, shared[3]), (106, "y" * 199), (107, "y" * 199)]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 3)])
def test_equals_brute_force(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as marks")
    got = sorted((tuple(r) for r in suffix.remove_repeats(df, block=block).collect()), key=repr)
    assert got == brute(rows, suffix.LENGTH)


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_of_megabytes(spark):
    rng = random.Random(9)
    block = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    rows = [(1, block + "left" + block[:150]), (2, "x" + block[300_000:301_000] + "y"), (3, None)]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "marks": F.lit(1)})).collect()}
    assert got[1]["n_bytes"] == 1_000_154 and got[1]["n_removed"] == 1000 and got[1]["n_spans"] == 1
    assert got[2]["n_removed"] == 1000 and got[2]["kept_sha256"] == hashlib.sha256(b"xy").hexdigest()
    assert got[3]["n_bytes"] == got[3]["n_removed"] == 0
