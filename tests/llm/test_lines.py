import random
from collections import Counter

from pyspark.sql import functions as F

from siltstone.llm import lines


def brute(rows):
    """(doc_id, text left, removed chunks) with every chunk compared by its whole text."""
    cut, times, owner = {}, Counter(), {}
    for d, t in set(rows):
        parts = []
        for a, b, n in lines.chunks(t or ""):
            part = (t or "")[a:b].removesuffix("\n")
            parts.append((a, b, part if n >= lines.LEAST and not part.isspace() else None))
        cut[d, t] = parts
    for d, t in rows:
        for _, _, part in cut[d, t]:
            if part is not None:
                times[part] += 1
                owner[part] = min(owner.get(part, lines.NO_ID), lines.NO_ID if d is None else d)
    out = []
    for d, t in rows:
        seen, kept, gone = set(), "", 0
        for a, b, part in cut[d, t]:
            away = part is not None and times[part] > 1 and not (owner[part] == (lines.NO_ID if d is None else d) and part not in seen)
            seen.add(part)
            kept, gone = kept + (t[a:b] if not away else ""), gone + away
        out.append((d, None if t is None else kept, gone))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.randint(0, 6)))
    shared = [[line() for _ in range(rng.randint(2, 9))] for _ in range(4)]
    rows = []
    for d in range(70):
        own = [line() for _ in range(rng.randint(0, 5))]
        for _ in range(rng.randint(0, 2)):
            own += rng.choice(shared) + [line() for _ in range(rng.randint(0, 2))]
        rows.append((d, "\n".join(own) + "\n" * rng.randint(0, 2)))
    return rows + [(70, rows[5][1]), (5, rows[5][1]), (71, None), (72, ""), (73, "\n\n\n\n"), (74, "one line"), (75, "one line"), (76, "a b\nc d\n" * 5000), (None, "\n".join(shared[0]))]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("clash"), "n_lines": F.lit("clash"), "h": F.lit(2)})
    got = lines.dedup_lines(df)
    assert sorted(((r["doc_id"], r["text"], r["n_removed_chunks"]) for r in got.collect()), key=repr) == brute(rows)
    assert sum(x[2] for x in brute(rows)) > 20 and got.select("key", "h").distinct().count() == 1


def test_borders_shift_with_the_content():
    rng = random.Random(8)
    body = ["".join(rng.choice("abcdef ") for _ in range(30)) for _ in range(200)]
    parts = lambda ls: {"\n".join(ls)[a:b].removesuffix("\n") for a, b, _ in lines.chunks("\n".join(ls))}
    assert len(parts(body) & parts(["a new line", *body])) >= 0.9 * len(parts(body))


def test_chunks_cover_the_text():
    for _, t in corpus():
        found = lines.chunks(t or "")
        assert "".join((t or "")[a:b] for a, b, _ in found) == (t or "")


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
