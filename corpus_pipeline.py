"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Rows that language identification rejects go: those without a letter, those whose best
language is less likely than all others together, and those of which a letter is ten times
less likely than usual in that language; ``lang`` of the rest is the language found. Where no
row has a language nothing is learnt and all rows stay as they are.
Runs of lines that stand elsewhere too are cut, and documents of which nothing but white space
is left by that go; one document of each group of near duplicates stays; documents into which
a benchmark item leaks go; the rest is encoded. Nulls: a null text is rejected as unknown, and
null or repeated ids stay documents of their own. Extra columns are not carried. An empty
table gives an empty one. SQL cannot express the stages (``ORACLE_SQL`` is None); the tests
hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm import bpe, dartminhash, decontam, langid, lines
from siltstone.llm.shared import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least posterior of a language, and the most that a letter may be less likely than usual (natural logarithms; about ln 10).
LEAST_SCORE, MOST_STRANGE = 0.5, 2.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with a score of ``LEAST_SCORE`` or more and no more than ``MOST_STRANGE`` in it.

    Without a labelled row nothing is learnt, and all rows stay with their ``lang``. Nulls and
    texts without a letter go otherwise; repeated rows get equal decisions, and an empty table
    gives an empty one.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.select(*COLUMNS)
    found = langid.predict(docs.select(*COLUMNS), model)
    told = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.coalesce("strange", F.lit(0.0)) <= MOST_STRANGE))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that stand at an earlier place too."""
    cut = lines.dedup_runs(docs.select(*COLUMNS))
    left = cut.where((F.col("n_removed_chunks") == 0) | F.rlike("text", F.lit(r"\S")))
    changed = F.when(F.col("n_removed_chunks") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return left.withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id, null last.

    Rows equal in doc_id and text are one document and stay or go together; texts without words,
    null ones too, are one class. An empty table gives an empty one.
    """
    return dartminhash.keep_one(docs.select(*COLUMNS), weight="count")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Null texts hold nothing and stay; rows with equal doc_id, nulls too, are judged together.
    An empty table gives an empty one, an empty benchmark leaves all rows.
    """
    return decontam.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all that is left; a null text is empty, repeated rows stay, no row goes."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
