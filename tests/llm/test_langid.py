import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import langid

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def every_segmentation(word, index, table):
    """The summed probability by enumeration; letters without a piece count as the last row."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(langid.PIECE_CHARS, len(word)) + 1):
        at = index.get(word[:n], -1 if n == 1 else None)
        if at is not None:
            total += table[at, 0] * every_segmentation(word[n:], index, table)
    return total


def test_forward_equals_enumeration():
    names = ["a", "b", "ab", "aba", "bb", "▁", "▁a", "▁ab"]
    pieces = langid.Pieces(names)
    table = np.random.default_rng(1).random((len(names) + 1, 1))
    words = ["a", "abab", "bbabab", "xaby", "é"]
    want = [np.log(every_segmentation("▁" + w, {p: k for k, p in enumerate(names)}, table)) for w in words]
    assert np.allclose(langid.score_words(words, pieces, table)[:, 0], want)


def test_held_out_accuracy(docs, model):
    found = langid.predict(docs.where(langid.held_out()), model).where("text rlike '[a-zA-Z]'")
    right, total = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 20 and right / total > 0.9


def test_held_out_rows_teach_nothing(docs, model):
    other = langid.fit(docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))))
    assert other.langs == model.langs and np.allclose(other.table, model.table)


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "12 !? ٣"), (4, "x" * 5000), (5, "the house of the people " * 9000), (5, "the house of the people " * 9000), (None, "the house of the people " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "_found0": F.lit(1)})
    got = langid.predict(df, model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"] or 9)[:3]] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["text"] and len(r["text"]) > 90_000}) == 1


def test_nothing_learnt(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = langid.fit(empty)
    assert langid.predict(empty, nothing).count() == 0
    assert langid.predict(spark.createDataFrame([(1, "words")], "doc_id long, text string"), nothing).first()["lang_pred"] == "und"


def test_expected_counts_equal_enumeration():
    names = ["a", "b", "ab", "aba", "▁", "▁a", "▁ab"]
    pieces, index = langid.Pieces(names), {p: k for k, p in enumerate(names)}
    table = np.random.default_rng(2).random((len(names) + 1, 1))

    def ways(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            at = index.get(word[:n], -1 if n == 1 else None)
            if at is not None:
                yield from ([at, *rest] for rest in ways(word[n:]))

    words, weights, want = ["▁aba", "▁abxab"], np.array([2.0, 3.0]), np.zeros(len(table))
    for w, weight in zip(words, weights):
        found = [(p, np.prod(table[p, 0])) for p in ways(w)]
        for p, chance in found:
            for at in p:
                want[at] += weight * chance / sum(c for _, c in found)
    assert np.allclose(langid.expected(words, weights, pieces, table), want)


def test_long_words_are_summed_over_all_segmentations(monkeypatch):
    names = ["a", "b", "ab", "aba", "bb", "▁", "▁a", "▁ab", "abbaabbaabbaabba"]
    pieces, index = langid.Pieces(names), {p: k for k, p in enumerate(names)}
    table = np.random.default_rng(3).random((len(names) + 1, 2)) * 1e-6
    words = ["abba" * 30, "ab" * 25 + "x" + "ba" * 40, "é" * 45, "a"]

    def dynamic(word, k):
        """Exact sums in whole multiples of tiny numbers: products are kept as logarithms."""
        from decimal import Decimal

        sums = [Decimal(1)]
        for t in range(1, len(word) + 1):
            now = Decimal(0)
            for n in range(1, min(16, t) + 1):
                at = index.get(word[t - n : t], len(names) if n == 1 else None)
                if at is not None:
                    now += sums[t - n] * Decimal(float(table[at, k]))
            sums.append(now)
        return float(sums[-1].ln())

    want = [[dynamic("▁" + w, k) for k in range(2)] for w in words]
    assert np.allclose(langid.score_words(words, pieces, table), want, rtol=1e-12)
    monkeypatch.setattr(langid, "STRETCH", 7)
    assert np.allclose(langid.score_words(words, pieces, table), want, rtol=1e-12)


def test_expected_counts_of_long_words():
    names = ["a", "b", "ab", "aba", "▁", "▁a", "▁ab"]
    pieces, table = langid.Pieces(names), np.random.default_rng(4).random((8, 1))
    for word in ("▁aba", "▁abxab", "▁abaabab"):
        assert np.allclose(langid.expected_long(word, 2.0, pieces, np.log(table)), langid.expected([word], np.array([2.0]), pieces, table))
    long = "▁" + "abaab" * 100
    got = langid.expected([long], np.array([1.0]), pieces, table)
    assert np.isclose(sum(n * len(p) for n, p in zip(got, names)) + got[-1], len(long))


def test_strangers_are_told_from_the_learnt(spark, model):
    rows = ["Suomen kieli on itämerensuomalainen kieli, jota puhutaan pääosin Suomessa ja Ruotsissa", "qwxz vbnk jjhgf trwq plmkn zzxcv", "这是一个用于测试的中文句子没有空格而且很长很长很长", "the house of the people is on the hill", None, "7"]
    got = langid.predict(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert all(r["strange"] > 2.3 for r in got[:3]) and got[3]["strange"] < 0 and got[4]["strange"] is None and got[5]["strange"] is None


def test_learnt_rows_are_not_strange(docs, model):
    assert langid.predict(docs, model).agg(F.max("strange")).first()[0] < 2.3


def test_a_dirty_language_column_is_bounded(docs):
    dirty = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    assert langid.fit(dirty, rounds=1, most_langs=4).langs == ["de", "en", "es", "fr"]


def test_a_tie_goes_to_the_first_language(spark):
    names = ["a", "▁"]
    model = langid.Model(["xx", "yy"], np.log([0.5, 0.5]), langid.Pieces(names), np.full((3, 2), 0.3))
    got = langid.predict(spark.createDataFrame([("a a",)], "text string"), model).first()
    assert got["lang_pred"] == "xx" and abs(got["score"] - 0.5) < 1e-9
