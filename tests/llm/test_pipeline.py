import regex

import corpus_pipeline
from siltstone.llm import bpe
from tests.llm import test_decontam, test_runs
from tests.llm.test_dartminhash import brute_classes
from tokenizers import Tokenizer


def test_equals_brute_force(spark):
    """Every stage again, by the brute-force versions of its operator."""
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, folder).collect()}
    rows = [(d, t) for d, t in rows if t and regex.search(r"\p{L}", t)]
    rows = [(d, t) for d, t, gone in test_runs.brute(rows) if not gone or t.strip()]
    low = {d: c for d, c in brute_classes(rows)}
    rows = [(d, t) for d, t in rows if low[d] == d]
    leaks = {d for d, *_ in test_decontam.brute(rows, items)}
    library = Tokenizer.from_file(bpe.VOCABULARY)
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in rows if d not in leaks}


def test_stages_keep_the_columns_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def odd_rows(spark):
    """Nulls in every column, empty and blank texts, a repeated row and a long text without spaces."""
    long = "x" * 200_000
    rows = [(1, None, None, None, None), (2, "", "en", "web", 0), (3, "   \n ", "en", "web", 5), (None, "a text with no id in it", None, None, None), (5, "one and the same row", "en", "web", 20), (5, "one and the same row", "en", "web", 20), (6, long, "en", "web", len(long))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_odd_rows_and_empty_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = odd_rows(spark).select(*(c if c not in docs.columns else docs.schema[c].name for c in docs.columns))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, folder).count() <= odd.count()
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_odd_rows_are_decided_as_told(spark):
    folder = "/root/testdata/sf0.001"
    odd = odd_rows(spark)
    left = lambda stage: sorted((r["doc_id"] or 0, r["text"] or "") for r in stage(spark, odd, folder).collect())
    every = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert left(corpus_pipeline.decontamination) == every
    assert left(corpus_pipeline.line_dedup) == every
    # Texts without words are one class; rows equal in doc_id and text are one document and stay together.
    assert [d for d, _ in left(corpus_pipeline.near_dedup)] == [0, 1, 5, 5, 6]


def test_clashing_extra_columns_change_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.selectExpr("*", "1 as score", "'z' as lang_pred", "2 as hash", "3 as class_id", "4 as n_removed_chunks", "5 as id", "6 as rank")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        key = lambda d: sorted((r["doc_id"], r["text"]) for r in stage(spark, d, folder).collect())
        assert key(more) == key(docs)


def test_languages_that_are_not_labelled_or_not_known(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = corpus_pipeline.language_id(spark, docs.withColumn("lang", corpus_pipeline.F.lit(None).cast("string")), folder)
    assert none.count() == docs.count() and none.where("lang is not null").count() == 0
    one = corpus_pipeline.language_id(spark, docs.withColumn("lang", corpus_pipeline.F.expr("if(lang = 'en', lang, null)")), folder)
    assert {r["lang"] for r in one.select("lang").distinct().collect()} == {"en"}
    assert one.join(docs.where("lang = 'en' and text rlike '[a-zA-Z]'"), "doc_id", "right").where(one["text"].isNull()).count() == 0
    stranger = spark.createDataFrame([(-1, "Suomen kieli on itämerensuomalainen kieli, jota puhutaan pääosin Suomessa", None, "web", 70), (-2, "qwxz vbnk jjhgf trwq plmkn zzxcv", None, "web", 32)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(stranger), folder).collect()}
    assert not kept & {-1, -2} and kept == {r["doc_id"] for r in docs.where(r"text rlike '\\p{L}'").collect()}
