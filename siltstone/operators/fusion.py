"""Fusion of ranked sources, duplicates, and reranking by several scorers.

Rows are (source, id, content, score, seq); ``seq`` orders a source. All ranks are windows
within a source, all sums partial aggregates by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Weights of sources and the rank constant (fixed values).
WEIGHTS = {"graph": 0.4, "code": 0.3, "docs": 0.3}
RRF_K = 60


def weight(source: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[source], F.lit(1.0))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds the 1-based ``rank`` within each source."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("seq")))


def normalised(rows: DataFrame) -> DataFrame:
    """Adds ``norm``: the score over its source's range, which counts as 1e-9 at least."""
    w = Window.partitionBy("source")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return rows.withColumn("norm", (F.col("score") - low) / F.greatest(high - low, F.lit(1e-9)))


def result_key(merge_across_sources: bool = False) -> list[Column]:
    """Rows with equal keys are one result; sources stay apart unless merged."""
    key = [F.col("id").alias("id"), F.substring("content", 1, 100).alias("prefix")]
    return key if merge_across_sources else [F.col("source").alias("source"), *key]


def fused(rows: DataFrame, part: Column, merge_across_sources: bool = False) -> DataFrame:
    """Sums weight x part by key; content and rank are those first seen."""
    w = rows.withColumns({"_id": F.col("id"), "_prefix": F.substring("content", 1, 100), "_part": part * weight(F.col("source"))})
    keys = ["_id", "_prefix"] if merge_across_sources else ["source", "_id", "_prefix"]
    firsts = F.min(F.struct("rank", "source", "content", "score")).alias("_f")
    out = w.groupBy(*keys).agg(F.sum("_part").alias("fused_score"), firsts)
    return out.select(F.col("_f.source").alias("source"), F.col("_id").alias("id"), F.col("_f.content").alias("content"), "fused_score", F.col("_f.score").alias("original_score"), F.col("_f.rank").alias("rank"))


def rrf(rows: DataFrame, k: int = RRF_K, merge_across_sources: bool = False) -> DataFrame:
    return fused(ranked(rows), 1.0 / (k + F.col("rank")), merge_across_sources)


def score_normalised(rows: DataFrame) -> DataFrame:
    return fused(normalised(ranked(rows)), F.col("norm"))


def weighted(rows: DataFrame) -> DataFrame:
    return fused(ranked(rows), F.col("score"))


def combined(rows: DataFrame) -> DataFrame:
    """Rank and score fusion added up by source and the beginning of the content, in one pass over the sources."""
    both = fused(normalised(ranked(rows)), 1.0 / (RRF_K + F.col("rank")) + F.col("norm"))
    return both.groupBy("source", F.substring("content", 1, 100).alias("prefix")).agg(F.sum("fused_score").alias("fused_score"), F.min("content").alias("content"))


def top(rows: DataFrame, n: int, score: str = "fused_score", *ties: str) -> DataFrame:
    """The n best, ties in the order given: one TakeOrderedAndProject, no full sort."""
    return rows.orderBy(F.desc(score), *ties).limit(n)


def keep_first(rows: DataFrame, *keys: Column, order: str = "seq") -> DataFrame:
    """The first row of each key, without a window over whole groups: the least order value by partial aggregates."""
    named = rows.withColumn("_k", F.struct(*keys))
    return named.groupBy("_k").agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_r")).select("_r.*")


def ensemble(scored: list[DataFrame]) -> DataFrame:
    """Mean score of each id over scorers (id, content, score); content of the first scorer that has it."""
    parts = [s.select("id", "content", "score", F.lit(k).alias("_order")) for k, s in enumerate(scored)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.avg("score").alias("score"), F.min_by("content", "_order").alias("content"))


def cascade(rows: DataFrame, rerankers: list, keep: float = 0.3, n: int = 10) -> DataFrame:
    """Apply rerankers in turn; a step that leaves under the share ``keep`` of its rows is skipped."""
    best, size = rows, rows.count()
    for rerank in rerankers:
        found = rerank(best)
        left = found.count()
        if left and left >= size * keep:
            best, size = found, left
    return best.limit(n)


def first_reranker(rows: DataFrame, rerankers: list, n: int = 10) -> DataFrame:
    """The first reranker that does not fail."""
    for rerank in rerankers:
        try:
            return rerank(rows).limit(n)
        except Exception:  # noqa: BLE001  a provider may fail in any way
            continue
    return rows.withColumn("score", F.coalesce("score", F.lit(0.5))).limit(n)
