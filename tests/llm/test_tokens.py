import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import bpe, tokencounts

LETTERS = "ab 'sTlld\n\t\r\x1c\x85 ​　é漢字①٣½🙂́.,!’s<>|0 9"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["", None, "a<|endoftext|>b\n<|endoftext|>", "x" * 3000, "ab" * 2000, " \n" * 400, "I'll've 'S"]


def test_ids_and_decoded_text_equal_the_library(spark, library):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.encode_documents(df, with_ids=True).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        want = library.encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_cuts_are_certain():
    enc = bpe.Encoder()
    for token in list(enc.bytes_of.values())[:2000]:
        assert all(enc.joined[p] for p in zip(token, token[1:])) or token == b"<|endoftext|>"


def test_a_full_cache_is_emptied(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    enc = bpe.Encoder()
    for t in texts()[:200]:
        assert enc.encode(t) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_sections_equal_the_librarys_offsets(spark, library, rule):
    rows = list(enumerate(texts()))
    got = {}
    for r in tokencounts.section_counts(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], r["n_tokens"]))
    enc = bpe.Encoder()
    for d, text in rows:
        text = text or ""
        borders = [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)] + [len(text)]
        counts = [0] * len(borders)
        at, ends = 0, np.cumsum([len(c.encode()) for c in text])
        for i in enc.encode(text):
            size = len(enc.bytes_of[i])
            a, b = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, at + size - 1, "right"))
            at += size
            of = [next(s for s, e in enumerate(borders) if c < e) for c in range(a, b + 1)]
            counts[of[0] if rule == "start" else of[-1] if rule == "end" else max(of, key=lambda s: (of.count(s), -s))] += 1
        want = [(k, ([0] + borders)[k], e, counts[k]) for k, e in enumerate(borders)]
        assert sorted(got[d]) == want, (text, rule)


def test_fields_add_up(spark, library):
    df = spark.createDataFrame([(1, "A title", "some body text"), (2, None, ""), (3, "", "é🙂")], "doc_id long, title string, body string")
    got = {}
    for r in tokencounts.field_counts(df, ["title", "body"]).collect():
        got.setdefault(r["doc_id"], {})[r["field"]] = r["n_tokens"]
    for d, t, b in [(1, "A title", "some body text"), (2, "", ""), (3, "", "é🙂")]:
        assert sum(got[d].values()) == len(library.encode(f"{t}\n{b}", add_special_tokens=False).ids)


def test_bad_rule(spark):
    with pytest.raises(ValueError):
        tokencounts.section_counts(spark.createDataFrame([], "doc_id long, text string"), "middle")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(empty).count() == 0 and tokencounts.section_counts(empty).count() == 0


def test_odd_rows_of_sections_and_fields(spark):
    rows = [(1, "a b\nc d\n"), (1, "a b\nc d\n"), (None, None), (2, "x" * 200_000 + "\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("section", "start", "n_tokens", "field")})
    got = sorted((r["doc_id"] or 0, r["section"], r["start"], r["end"]) for r in tokencounts.section_counts(df).collect())
    assert got == [(0, 0, 0, 0), (1, 0, 0, 4), (1, 0, 0, 4), (1, 1, 4, 8), (1, 1, 4, 8), (2, 0, 0, 200_001), (2, 1, 200_001, 200_002)]
    fields = tokencounts.field_counts(df.withColumn("other", F.lit(None).cast("string")), ["text", "other"]).collect()
    assert len(fields) == 8 and all(r["n_tokens"] >= 0 for r in fields)
    assert sorted(r["n_tokens"] for r in fields if r["doc_id"] is None) == [0, 1]
    assert tokencounts.field_counts(df.limit(0), ["text"]).count() == 0


def test_the_vocabulary_is_the_public_one():
    import public_tokenizers

    assert bpe.VOCABULARY == public_tokenizers.path("byte_bpe_50k.json")
