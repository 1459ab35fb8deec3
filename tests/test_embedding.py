"""The hashing embedder, nearest neighbours and the chunkers that embed, against brute force and by hand."""

import hashlib
import html.parser
import json
import random
import re
import tracemalloc

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from siltstone.operators import chunk, embedding

TEXTS = ["Alpha beta, alpha!", "", None, "Äpfel und Öl", "alpha beta alpha", "Alpha beta, alpha!", "w " * 30_000, "12 + 7"]


def by_hand(text, dims=embedding.DIMS):
    """Every feature of every word, one at a time."""
    v = [0] * dims
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        for f in [f"<{word}>"] + [f"<{word}>"[i : i + 3] for i in range(len(word))]:
            h = int(hashlib.md5(f.encode()).hexdigest()[:15], 16)
            v[h % dims] += 1 if (h // dims) % 2 == 0 else -1
    n = sum(x * x for x in v) ** 0.5
    return [x / n if n else 0.0 for x in v]


def table(spark, texts=TEXTS):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    return rows.withColumns({"text_hash": F.lit("clash"), "embedding": F.lit(1), "_t": F.lit(2)}).repartition(3)


def test_embed_rows(spark):
    got = {r["id"]: r for r in embedding.embed_rows(table(spark)).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for k, text in enumerate(TEXTS):
        assert got[k]["embedding"] == pytest.approx(by_hand(text), abs=1e-12)
        assert got[k]["text_hash"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert got[0]["embedding"] == got[5]["embedding"] and got[0]["embedding"] == got[4]["embedding"]
    assert embedding.embed_rows(table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("stretch", [3, 8192])
def test_many_texts_at_once_equal_one_by_one(monkeypatch, stretch):
    monkeypatch.setattr(embedding, "STRETCH", stretch)
    monkeypatch.setattr(embedding, "CACHE_WORDS", 400)
    rng = random.Random(stretch)
    texts = ["", "a\0b \0c", "\0", "x y z " * 5, "!?"] + [" ".join(rng.choice(["ab", "Cé", "d1", "word", "longer", "ünit"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    got = embedding.Hashing(32)(texts)
    for t, v in zip(texts, got):
        want = by_hand(t.replace("\0", " "), 32)
        norm = float(v @ v) ** 0.5
        assert [x / norm if norm else 0.0 for x in v.tolist()] == pytest.approx(want)
    assert embedding.Hashing(8)([]).shape == (0, 8)


def test_known_words_hold_their_places_only():
    text = " ".join(f"w{k * 7919:x}" for k in range(60_000))
    tracemalloc.start()
    try:
        got = embedding.Hashing()([text])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    v = got[0].astype(float)
    assert (v / np.sqrt(v @ v)).tolist() == pytest.approx(by_hand(text))
    assert most < 60e6  # rows of 256 cells a word take over 60 MB by themselves


def test_words_of_other_alphabets_equal_the_pattern():
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(0x20, 0x600), *range(0x900, 0x980), *range(0x1D400, 0x1D440), 0x2019, 0x2161, 0x00BD, 0x3007]]
    texts = ["".join(rng.choices(letters[: rng.choice([100, 900, len(letters)])], k=120)) for _ in range(300)]
    for t, v in zip(texts, embedding.Hashing(32)(texts)):
        want = embedding.Hashing(32)([" ".join(regex.findall(r"[\p{L}\p{N}]+", t.lower()))])[0]
        assert v.tolist() == want.tolist(), t


def test_distinct_texts_go_through_the_model_once(spark, tmp_path):
    def counted():
        def model(texts):
            with open(tmp_path / "seen", "a") as f:
                f.write("".join(f"{t!r}\n" for t in texts))
            return np.ones((len(texts), 2))

        return model

    rows = embedding.embed_rows(table(spark, ["a", "b", "a", None, ""] * 40), make=counted)
    assert rows.count() == 200
    assert sorted((tmp_path / "seen").read_text().split()) == ["''", "'a'", "'b'"]


def test_models_and_points(spark):
    rows = spark.createDataFrame([("c0", "s", 0, "plain words"), ("c1", "s", 1, "простые слова")], "chunk_id string, source_id string, chunk_index int, content string")
    made = embedding.embed_chunks(rows, "qwen")
    assert {r["chunk_id"]: (r["provider"], r["model"]) for r in made.collect()}["c1"] == ("qwen", "text-embedding-v3")
    named = spark.createDataFrame([("s", 0, ["A", "B"]), ("s", 9, ["C"])], "source_id string, chunk_index int, entities array<string>")
    got = embedding.points(made, "tag", named).collect()
    assert [(r["id"], r["payload"]["entities"], len(r["vector"])) for r in got] == [("c0", "A|B", embedding.DIMS)]
    assert embedding.points(made).count() == 2


@pytest.mark.parametrize("size,most", [(7, 3), (1024, 32_768)])
def test_neighbours(spark, size, most):
    rng = np.random.default_rng(size)
    x = rng.integers(-2, 3, (60, 5)).astype(float)  # few directions: many ties, and vectors of length 0
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(None, [1.0] * 5), (99, None), (98, [])], "id long, embedding array<double>").repartition(4)
    asked = rows.where("id % 10 = 0")
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n > 0, n, 1)[:, None]
    score = np.round(u @ u.T, 9) + 0.0
    want = {(q, r + 1, int(i), float(score[q, i])) for q in range(0, 60, 10) for r, i in enumerate(np.lexsort((np.arange(60), -score[q]))[:4])}
    assert {tuple(r) for r in embedding.neighbours(rows, asked, 4, size, most).collect()} == want
    assert embedding.neighbours(rows, rows.limit(0), 4).count() == 0


def test_products_that_single_precision_cannot_tell_apart_are_ranked():
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    rows = embedding.scaled(base + rng.normal(size=(3000, 64)) * 1e-4)  # products within some 1e-6 of each other
    asked = embedding.scaled(base + rng.normal(size=(7, 64)) * 1e-4)
    kept = embedding.Best(asked, 5)
    for a in range(0, 3000, 500):
        kept.see(np.arange(a, a + 500), rows[a : a + 500], 4)
    score = np.round(asked @ rows.T, 9)
    for q in range(7):
        assert [i for _, i in kept.found[q]] == np.lexsort((np.arange(3000), -score[q]))[:5].tolist()


def test_neighbours_embed_and_join_once(spark, tmp_path, monkeypatch):
    from siltstone import queries_embedding as own

    made = []

    def counted(spark, d):
        rows = spark.range(100).select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i)).alias("embedding"))
        log = str(tmp_path / "seen")

        def seen(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.write("\n" * len(b))
                yield b

        made.append(log)
        return rows.mapInArrow(seen, rows.schema)

    monkeypatch.setattr(own, "embedded_documents", counted)
    assert own.embedding_neighbours(spark, "").count() == 25
    assert len(open(made[0]).read()) == 100  # and not again for the queries


def semantic_by_hand(text, share=0.95):
    parts, at = [], 0
    for m in re.finditer(r"[.!?]+\s+", text):
        parts.append(text[at : m.end()])
        at = m.end()
    parts += [text[at:]] if at < len(text) else []
    near = [by_hand(" ".join(parts[max(0, k - 1) : k + 2])) for k in range(len(parts))]
    far = [1 - np.dot(a, b) if any(a) and any(b) else 1.0 for a, b in zip(near, near[1:])]
    limit = np.percentile(far, share * 100) if far else 0
    out, held = [], ""
    for k, part in enumerate(parts):
        held += part
        if k < len(far) and far[k] > limit + 1e-12:
            out.append(held)
            held = ""
    return [*out, held] if held else out


def test_distances_of_long_texts_go_on_over_stretches(spark, monkeypatch):
    rng = random.Random(8)
    texts = [[rng.choice(["a b", "b c d", "!", "e"]) for _ in range(n)] for n in (0, 1, 2, 3, 9, 10, 11, 31, 4, 64)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, s array<string>").coalesce(1)
    for buffer in (1, 2):
        whole = [r["d"] for r in df.select("id", chunk.adjacent_distances(F.col("s"), buffer).alias("d")).orderBy("id").collect()]
        want = []
        for t in texts:
            near = [np.array(by_hand(" ".join(t[max(0, k - buffer) : k + buffer + 1]))) for k in range(len(t))]
            want.append([1 - float(a @ b) if a.any() and b.any() else 1.0 for a, b in zip(near, near[1:])])
        assert all(np.allclose(a, b) and len(a) == len(b) for a, b in zip(whole, want))
        held = chunk.STRETCH
        try:
            chunk.STRETCH = 10
            parts = list(chunk.distances_of(texts, buffer))
        finally:
            chunk.STRETCH = held
        assert all(np.allclose(a, b) and len(a) == len(b) for a, b in zip(parts, want))


@pytest.mark.parametrize("share,buffer", [(0.95, 1), (0.1, 0), (0.9, 3)])
def test_cuts_equal_distances_over_their_percentile(spark, share, buffer):
    rng = random.Random(buffer)
    texts = [[rng.choice(["a b", "b c d", "!", "e", "f g"]) for _ in range(n)] for n in (0, 1, 2, 3, 9, 40, 64)] + [["same"] * 5, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, s array<string>").coalesce(1)
    df = df.withColumn("d", chunk.adjacent_distances(F.col("s"), buffer))
    got = df.select("id", "d", chunk.percentile(F.col("d"), share).alias("t"), chunk.cuts(F.col("s"), share, buffer).alias("c")).collect()
    assert len(got) == len(texts) and any(r["c"] for r in got)
    for r in got:
        assert r["c"] == [k + 1 for k, x in enumerate(r["d"]) if x > r["t"]]


def test_semantic(spark):
    rng = random.Random(3)
    topics = [["cat", "dog", "paw", "tail"], ["stock", "bond", "yield", "rate"], ["rain", "wind", "cloud"]]
    text = lambda n: "".join(" ".join(rng.choices(topics[k // 5 % 3], k=4)) + rng.choice([". ", "!\n", "? "]) for k in range(n))
    texts = [text(40), text(23), "One sentence only.", "no end", "", None, "   ", "Same. Same. Same. Same.", "Two. Ways!", ". . .", "x" * 100_000 + ". y"]
    got = {}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string").withColumns({"_s": F.lit("clash"), "chunk_index": F.lit(9)})
    for r in chunk.semantic(rows).collect():
        got.setdefault(r["id"], []).append((r["chunk_index"], r["content"]))
    for k, t in enumerate(texts):
        have = [c for _, c in sorted(got.get(k, []))]
        assert have == (semantic_by_hand(t) if t and t.strip() else []), k
        assert "".join(have) == (t if t and t.strip() else "")
    assert len(got[0]) > 1 and len(got[7]) == 1


def test_percentile(spark):
    rows = [[0.3], [1.0, 2.0], [5.0, 1.0, 4.0, 2.0], [float(k * k % 17) for k in range(50)]]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    assert [r[0] for r in df.select(chunk.percentile(F.col("v"), 0.95)).collect()] == pytest.approx([np.percentile(r, 95) for r in rows])


def test_sentence_chunks():
    rng = random.Random(1)
    for n in (0, 1, 5, 60):
        text = "".join("w" * rng.randint(1, 90) + rng.choice([". ", "! ", "?\n"]) for _ in range(n)) + "z" * (700 if n == 60 else 0)
        out = list(chunk.sentence(text, 200, 60))
        covered = set()
        for k, (number, piece, start, end, _, _) in enumerate(out):
            assert number == k and piece == text[start:end].strip() and 0 < end - start <= 200
            covered |= set(range(start, end))
        assert covered == set(range(len(text)))
        assert all(a[2] < b[2] and b[2] >= a[3] - 60 for a, b in zip(out, out[1:]))
    assert list(chunk.sentence("  \n")) == []


def test_html_chunks():
    page = "<html><body>lost<div>a <b>bold</b><p>one<p>two &amp; <i>more</i></p>b</div><section><script>no</script>c</section><p>three</p>"
    assert [(c[4], c[1]) for c in chunk.html(page)] == [("div", "a boldb"), ("p", "one\ntwo & more"), ("section", "c"), ("p", "three")]
    assert list(chunk.html("")) == [] and [c[1] for c in chunk.html("<p>open")] == ["open"]


def test_html_chunks_hold_all_text_under_the_tags(spark):
    """Another way: every piece of text with its innermost wanted tag, by a plain event list."""

    class Events(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.words = [], []

        def handle_starttag(self, tag, attrs):
            if tag == "p" and [t for t in self.open if t in WANTED][-1:] == ["p"]:
                self.handle_endtag("p")
            if tag in WANTED or tag in ("script", "style"):
                self.open.append(tag)

        def handle_endtag(self, tag):
            if tag in self.open:
                while self.open.pop() != tag:
                    pass

        def handle_data(self, data):
            if self.open and not {"script", "style"} & set(self.open):
                self.words += data.split()

    WANTED = ("p", "div", "section", "article")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    got = {}
    for r in chunk.chunks(pages, "html").collect():
        got.setdefault(r["source_id"], []).append(r["content"])
    for r in pages.collect():
        e = Events()
        e.feed(r["content"])
        assert sorted("".join(" ".join(got.get(str(r["id"]), [])).split())) == sorted("".join(e.words))


def test_json_chunks():
    value = {"a": {"b": {"c": 1, "d": [2, 3]}, "e": None}, "f": "text", "g": [], "h": [True, {"k": "v"}]}
    assert [(c[5], c[1]) for c in chunk.json_parts(json.dumps(value))] == [("a.b", 'a b {"c": 1, "d": [2, 3]}'), ("a.e", "a e null"), ("f", "f text"), ("g", "g []"), ("h.0", "h 0 true"), ("h.1", 'h 1 {"k": "v"}')]
    assert [c[1] for c in chunk.json_parts("7")] == ["7"] and list(chunk.json_parts("{no")) == []
