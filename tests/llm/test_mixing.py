import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected(rows, weights=(5, 2, 1), repeats=3):
    """Sorts every source's documents and walks along them until the budget is met."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += words(text)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        rate = (total - sum(repeats * size[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
        more = {s for s in order if s not in full and weight[s] * rate > repeats * size[s]}
        if not more:
            break
        full |= more
    out = []
    for s in order:
        target = float(repeats * size[s]) if s in full else weight[s] * rate
        epochs = int(target // size[s]) if size[s] else 0
        budget, before = target - epochs * size[s], 0
        docs = sorted((hashlib.md5(f"{'' if i is None else i}:{text or ''}".encode()).hexdigest(), i, text) for i, text, source in rows if source == s)
        for _, i, text in docs:
            n = words(text)
            taken = n * (epochs + (2 * before + n <= 2 * budget))
            out.append((i, n, size[s], target, taken))
            before += n
    return out


def table(spark, rows):
    """With columns whose names the operator uses itself."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("size", "source_size", "target", "taken", "key", "bucket", "_of", "cut", "weight")}).repartition(3)


def check(spark, rows):
    got = [tuple(r) for r in mixing.mix(table(spark, rows)).collect()]
    want = expected(rows)
    assert Counter((g[:3], g[4]) for g in got) == Counter((w[:3], w[4]) for w in want)
    assert {g[2]: g[3] for g in got} == pytest.approx({w[2]: w[3] for w in want})
    return got


def test_equals_sorting(spark):
    rows = [(k, "w " * (1 + k * 7919 % 41), f"s{k % 3}" if k % 4 else "hot") for k in range(400)]
    got = check(spark, rows)
    taken, target = defaultdict(int), {}
    for _, _, s, t, n in got:
        taken[s] += n
        target[s] = t
    assert all(abs(taken[s] - target[s]) <= 21 for s in taken)


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [(1, None, "a"), (None, "x y\x0bz", None), (3, "", "b"), (4, " \t\n", "b"), (5, "one", "b"), (5, "one", "b"), (5, "one", "b"), (6, "é è \U0001f600", "\U0001f600"), (7, "long " * 100_000, "z"), (8, "a b c", "")]
    check(spark, rows)


def test_small_sources_stop_at_three_times_and_pass_the_rest_on(spark):
    rows = [(k, "w " * 10, "a" if k < 2 else "b") for k in range(50)]
    got = check(spark, rows)
    assert {r["target"] for r in mixing.mix(table(spark, rows)).collect()} == {60.0, 440.0}
    assert all(n <= 3 * size for _, size, _, _, n in got)


def test_equal_rows_are_told_apart(spark):
    rows = [(1, "w", "a")] * 60 + [(2, "w w", "b")] * 50
    got = [tuple(r) for r in mixing.mix(table(spark, rows)).collect()]
    taken = Counter()
    for i, _, _, _, n in got:
        taken[i] += n
    assert abs(taken[1] - 160 * 5 / 7) <= 1 and abs(taken[2] - 160 * 2 / 7) <= 2


def test_a_smaller_share_is_nested(spark):
    rows = [(k, "w " * (1 + k % 13), f"s{k % 2}") for k in range(200)]
    less, more = ({r["doc_id"]: r["taken"] for r in mixing.mix(table(spark, rows), share=s).collect()} for s in (0.3, 0.7))
    assert all(less[k] <= more[k] for k in less) and less != more


def test_an_empty_table(spark):
    assert mixing.mix(table(spark, [])).collect() == []


def test_sources_are_numbered_by_code_point(spark):
    names = ["￿", "\U0001f600", "a", "B", "", None, "é"]
    got = {r["source"]: r["place"] for r in mixing.numbered(spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    assert sorted(got, key=got.get) == ["", "B", "a", "é", "￿", "\U0001f600", None]


def test_runs_no_python(spark):
    plan = mixing.mix(table(spark, [(1, "a b", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
