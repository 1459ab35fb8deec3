import random

import corpus_pipeline
from siltstone.llm import lines
from tests.llm.test_lines import corpus


def brute(rows, least=lines.LEAST, long=lines.LONG):
    """(doc_id, text left, removed lines), with all runs compared by their whole texts in order of place."""
    cut = lambda t: [p + "\n" for p in t[: -t.endswith("\n") or None].split("\n")] if t else []
    order = sorted({(lines.NO_ID if d is None else d, t or "") for d, t in rows}, key=lambda x: x[0])
    seen, gone = set(), {}
    for d, t in order:
        ls = [p.removesuffix("\n") for p in cut(t)]
        away = gone.setdefault((d, t), set())
        for n in (1, least):
            for k in range(len(ls) - n + 1):
                run = tuple(ls[k : k + n])
                if "\n".join(run).strip() and (n > 1 or len(run[0].split()) > long):
                    if run in seen:
                        away.update(range(k, k + n))
                    seen.add(run)
    out = []
    for d, t in rows:
        away = gone[lines.NO_ID if d is None else d, t or ""]
        whole = cut(t or "")
        kept = "".join(p for k, p in enumerate(whole) if k not in away)
        out.append((d, None if t is None else kept if kept == "" or t.endswith("\n") or len(whole) - 1 in away else kept[:-1], len(away)))
    return sorted(out, key=repr)


def removed(spark, rows):
    got = lines.dedup_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(((r["doc_id"], r["text"], r["n_removed_lines"]) for r in got.collect()), key=repr)


def test_equals_brute_force(spark):
    rows = [(d, t) for d, t in corpus() if d is not None]
    assert removed(spark, rows) == brute(rows)


def test_every_shared_block_goes_whatever_stands_around_it(spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(6))
    rows, planted = [], 0
    for n in (2, 4, 8):
        for _ in range(60):
            block = [line() for _ in range(n)]
            for _ in range(2):
                rows.append((len(rows), "\n".join([line() for _ in range(rng.randint(1, 6))] + block + [line() for _ in range(rng.randint(1, 6))])))
            planted += n
    got = removed(spark, rows)
    assert sum(n for *_, n in got) == planted and got == brute(rows)
    chunked = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).groupBy().sum("n_removed_lines").first()[0]
    print("planted", planted, "removed as chunks", chunked)
    assert chunked < planted


def test_a_long_line_is_a_passage_and_texts_of_one_id_are_apart(spark):
    passage, short = " ".join(f"w{k}" for k in range(51)), " ".join(f"w{k}" for k in range(50))
    rows = [(1, f"own\n{passage}\n{short}"), (2, f"{passage}\nother\n{short}"), (3, "a b\nc d"), (3, "e\na b\nc d"), (None, "a b\nc d\nx"), (4, None), (5, "")]
    got = removed(spark, rows)
    assert (2, f"other\n{short}", 1) in got and (None, "x", 2) in got and (4, None, 0) in got and (5, "", 0) in got
    assert sum(n for d, _, n in got if d == 3) == 2


def test_the_pipeline_stage_removes_runs(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = [(d, t) for d, t, n in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if not n or t.strip()]
    assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, docs, folder).collect()), key=repr) == left
