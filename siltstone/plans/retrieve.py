"""Retrieval strategies: each is one plan over the sources, ended by a top-k.

A source is a function (query, limit) -> DataFrame of (source, id, content, score, seq);
``id`` is a string. A source that fails at analysis counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

from siltstone.functions.text import refine_terms
from siltstone.operators import fusion, graph, linking, reasoning, retrieval
from siltstone.storage import cut

Source = Callable[[str, int], DataFrame]
COLUMNS = ["source", "id", "content", "score", "seq"]
SCHEMA = "source string, id string, content string, score double, seq long"
CONFIDENT, WEAK = 0.8, 0.7


def rows(found: DataFrame, source: str, score: str = "score") -> DataFrame:
    """Source rows in result form, numbered in their order."""
    w = Window.orderBy(F.desc("score"), "_seq")
    out = found.select(F.lit(source).alias("source"), F.col("id").cast("string").alias("id"), "content", F.col(score).cast("double").alias("score"), F.col("seq").alias("_seq"))
    return out.withColumn("seq", F.row_number().over(w).cast("long")).select(*COLUMNS)  # at most limit rows


def docs_source(docs: DataFrame) -> Source:
    return lambda query, limit: rows(retrieval.ranked_scan(docs, query, limit), "docs")


def events_source(events: DataFrame, name: str = "code") -> Source:
    """Events whose message holds words of the query, under the given name."""
    as_docs = events.select("id", F.col("message").alias("content"), "seq")
    return lambda query, limit: rows(retrieval.ranked_scan(as_docs, query, limit), name)


def graph_source(nodes: DataFrame, edges: DataFrame) -> Source:
    def search(query: str, limit: int) -> DataFrame:
        n = nodes.select("id", F.lower("name").alias("content"))
        out = retrieval.ranked_scan(n.withColumn("seq", F.col("id")), query, limit)
        degree = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
        return rows(out.join(degree, "id", "left").withColumn("content", F.concat_ws(" ", "content", F.lit("degree"), F.coalesce("degree", F.lit(0)).cast("string"))), "graph")

    return search


def vector_source(rows_: DataFrame, embed: Callable[[str], list[float]], name: str = "docs") -> Source:
    """Rows (id, content, embedding, seq) nearest to the query's vector, which the given function makes."""
    return lambda query, limit: rows(retrieval.vector_scan(rows_, embed(query), limit), name)


def hop_source(nodes: DataFrame, edges: DataFrame, hops: int = 3) -> Source:
    """Paths from the nodes whose names hold the query, shorter ones first; a path is its own content."""

    def search(query: str, limit: int) -> DataFrame:
        found = graph.multi_hop(nodes, edges, query, hops, limit)
        order = F.row_number().over(Window.orderBy("hops", "path")).cast("long")  # at most limit rows
        return rows(found.select(F.col("path").alias("id"), F.col("path").alias("content"), (1.0 / F.col("hops")).alias("score"), order.alias("seq")), "graph")

    return search


def gathered(spark: SparkSession, sources: dict[str, Source], names: list[str], query: str, limit: int) -> DataFrame:
    """UNION ALL of the named sources; one that cannot be planned is empty."""
    parts = [spark.createDataFrame([], SCHEMA)]
    for name in names:
        try:
            parts.append(sources[name](query, limit).select(*COLUMNS))
        except (AnalysisException, KeyError):
            continue
    return reduce(DataFrame.unionByName, parts)


def fuse(found: DataFrame, limit: int, method: str = "rrf") -> DataFrame:
    how = {"rrf": fusion.rrf, "score_normalized": fusion.score_normalised, "weighted": fusion.weighted}
    if method == "combined":
        return fusion.top(fusion.combined(found), limit, "fused_score", "source", "prefix")
    return fusion.top(how[method](found), limit, "fused_score", "source", "id")


def vector_only(spark: SparkSession, sources: dict[str, Source], query: str, limit: int = 10) -> DataFrame:
    return fuse(gathered(spark, sources, ["code", "docs"], query, limit), limit)


def graph_only(spark: SparkSession, sources: dict[str, Source], query: str, limit: int = 10) -> DataFrame:
    return fuse(gathered(spark, sources, ["graph"], query, limit), limit)


def multi_hop(spark: SparkSession, sources: dict[str, Source], query: str, limit: int = 10) -> DataFrame:
    """Paths of several hops if there is such a source, else the graph, with documents."""
    return fuse(gathered(spark, sources, ["hops" if "hops" in sources else "graph", "docs"], query, limit), limit)


def hybrid(spark: SparkSession, sources: dict[str, Source], query: str, limit: int = 10, method: str = "rrf") -> DataFrame:
    return fuse(gathered(spark, sources, ["graph", "docs", "code"], query, limit), limit, method)


def terms_of(found: DataFrame, most: int = 3) -> list[str]:
    """Up to ``most`` names and as many keywords of the first results, for the next round: at most ten words reach the driver."""
    first = found.orderBy("seq").limit(3).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), " ").alias("c"))
    names, keys = refine_terms(F.col("c"))
    got = first.select(F.slice(names, 1, most).alias("n"), F.slice(keys, 1, most).alias("k")).first()
    return [*(got["n"] or []), *(got["k"] or [])] if got else []


def cascade(spark: SparkSession, sources: dict[str, Source], query: str, limit: int = 10) -> DataFrame:
    """Documents, then code for the query with their terms, then the graph if there were names."""
    first = gathered(spark, sources, ["docs"], query, max(1, limit // 2))
    extra = terms_of(first)
    refined = " ".join([query, *extra])
    parts = first.unionByName(gathered(spark, sources, ["code"], refined, max(1, limit // 2)))
    if any(t[0].isupper() for t in extra):
        parts = parts.unionByName(gathered(spark, sources, ["graph"], refined, limit))
    return fuse(parts, limit)


def iterative(spark: SparkSession, sources: dict[str, Source], query: str, limit: int = 10, rounds: int = 3) -> DataFrame:
    """Up to three rounds, each with the query refined, until the mean score is confident; repeats are dropped."""
    found, now = None, query
    for _ in range(rounds):
        part = gathered(spark, sources, ["docs", "code"], now, limit)
        found = part if found is None else found.unionByName(part)
        confidence = part.agg(F.avg("score")).first()[0] or 0.0
        if confidence >= CONFIDENT:
            break
        if confidence < WEAK:
            now = " ".join([query, *terms_of(part)])[:500]
    once = fusion.keep_first(found, F.col("source"), F.substring("content", 1, 100))
    return fuse(once, limit)


@dataclass
class Round:
    """What one round of ``unseen`` asked, which source answered, how many rows were new, and its confidence."""

    source: str
    query: str
    new: int
    confidence: float
    refined: str | None


def unseen(spark: SparkSession, sources: dict[str, Source], query: str, limit: int = 10, rounds: int = 3, least: int = 3, confident: float = 0.7, order: list[str] | None = None, refine: Callable[[str, DataFrame], str | None] | None = None) -> tuple[DataFrame, list[Round]]:
    """Rows that rounds of retrieval found for the first time (with ``round``), and the rounds.

    Each round asks the source with the best running average of past mean scores (a source not
    asked yet counts 1; ties by ``order``) and keeps what an anti join on the content leaves.
    A round's average moves half way to its mean score. Rounds end when there are ``least``
    rows and the confidence is reached, when the refined query is the same or none, or after
    ``rounds``. What was found is written each round; only counts and means reach the driver.
    """
    names = order or list(sources)
    average: dict[str, float | None] = {n: None for n in names}
    seen, told, now, total = cut(spark.createDataFrame([], f"{SCHEMA}, round int")), [], query, 0
    for k in range(rounds):
        name = max(names, key=lambda n: (1.0 if average[n] is None else average[n], -names.index(n)))
        got = gathered(spark, sources, [name], now, limit)
        once = fusion.keep_first(got, F.coalesce("content", F.lit("")))
        new = cut(once.join(seen.select(F.col("content").alias("_c")), F.col("content").eqNullSafe(F.col("_c")), "left_anti").withColumn("round", F.lit(k + 1)).select(*COLUMNS, "round"))
        n, mean = new.agg(F.count("*"), F.avg(F.coalesce("score", F.lit(0.0)))).first()
        total += n
        confidence = max(0.0, min(1.0, mean + min(total / 10.0, 0.3) - min(k * 0.1, 0.3))) if n else 0.0
        average[name] = (mean or 0.0) if average[name] is None else (average[name] + (mean or 0.0)) / 2
        seen = cut(seen.unionByName(new))
        done = total >= least and confidence >= confident
        refined = None if done else (refine or expanded)(now, seen.orderBy("round", "seq"))
        told.append(Round(name, now, n, confidence, refined if refined != now else None))
        if done or not refined or refined == now:
            break
        now = refined
    return seen, told


def expanded(query: str, found: DataFrame) -> str | None:
    """The query's words with two new words of over four letters from each of the first three contents, in order."""
    first = found.limit(3).withColumn("_n", F.row_number().over(Window.orderBy("round", "seq")))
    words = first.select("_n", F.posexplode(F.split(F.lower(F.coalesce("content", F.lit(""))), r"\s+")).alias("p", "w")).where("length(w) > 4")
    terms = set(query.lower().split())
    held = words.where(~F.col("w").isin(sorted(terms)))
    few = held.withColumn("_k", F.row_number().over(Window.partitionBy("_n").orderBy("p"))).where("_k <= 8").orderBy("_n", "p").select("_n", "w").collect()  # 24 words at most
    for n in (1, 2, 3):
        terms.update([r["w"] for r in few if r["_n"] == n and r["w"] not in terms][:2])
    out = " ".join(sorted(terms))
    return out if out != query else None


def adaptive(spark: SparkSession, sources: dict[str, Source], steps: list[str], query: str, intent: str, limit: int = 10) -> DataFrame:
    """Rows (with ``step``) of an agent's steps: all of them to troubleshoot (one after the other) or to design (at once), else as many steps as it takes to have ``limit`` rows.

    Errors of a source leave it out. A cascade is one plan: steps are united with their counts, and those behind a full prefix are dropped.
    """
    parts = [gathered(spark, sources, [name], query, limit).withColumn("step", F.lit(k)) for k, name in enumerate(steps)]
    out = reduce(DataFrame.unionByName, parts)
    if intent in ("troubleshoot", "design"):
        return out
    counts = out.groupBy("step").agg(F.count("*").alias("n"))  # a row a step
    before = F.coalesce(F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = counts.withColumn("_before", before).where(F.col("_before") < limit).select("step")
    return out.join(F.broadcast(used), "step", "left_semi").select(*COLUMNS, "step")


def with_fallback(found: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """Rows of ``more`` appended, not fused, if ``found`` has fewer than ``limit``: one plan, without counting first."""
    numbered = found.withColumn("_b", F.lit(0)).unionByName(more.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    return numbered.orderBy("_b", "seq").limit(limit).drop("_b")


def placed(found: DataFrame, score: str, limit: int) -> DataFrame:
    """The best ``limit`` rows with their ``rank``, ties by source and id."""
    best = found.orderBy(F.desc(score), "source", "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "source", "id")))  # at most limit rows


def reranked(spark: SparkSession, sources: dict[str, Source], query: str, rerank: Callable[[DataFrame], DataFrame], limit: int = 10) -> DataFrame:
    """(rank, source, id, content, score, snippet): twice as many fused rows as wanted, scored again, the best kept.

    ``rerank`` sets ``score``. The first row's content is the answer, and ``rank`` the number it is cited by.
    """
    best = placed(rerank(hybrid(spark, sources, query, 2 * limit)), "score", limit)
    return best.select("rank", "source", "id", "content", "score", F.substring("content", 1, 200).alias("snippet"))


def graph_aware(spark: SparkSession, sources: dict[str, Source], query: str, nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """One row: (query, results, entities, relations, answer, confidence).

    Entities are the first ``limit`` nodes whose names the query holds, relations the number of
    their edges. The answer is that of the results that hold one of the names, of all if none does.
    """
    asked = spark.createDataFrame([(query, query)], "qid string, query string")
    named = asked.select("qid", refine_terms(F.col("query"))[0].alias("names"))
    links = linking.linked_entities(named, nodes, edges).groupBy("qid", "node").agg(F.count("other").alias("edges"))
    known = links.orderBy("node").limit(limit).groupBy("qid").agg(F.array_sort(F.collect_list("node")).alias("entities"), F.sum("edges").alias("relations"))
    top = placed(hybrid(spark, sources, query, limit), "fused_score", limit)
    facts = reasoning.gathered(top.select(F.lit(query).alias("qid"), "content", "source", F.col("fused_score").alias("score"), "rank"))
    every = named.join(known, "qid", "left").join(facts, "qid", "left")
    given = every.withColumns({"facts": F.coalesce("facts", F.array().cast("array<struct<rank: int, content: string, source: string, score: double>>")), "entities": F.coalesce("entities", F.array().cast("array<string>")), "relations": F.coalesce("relations", F.lit(0))})
    about = given.withColumns({"results": F.col("facts"), "facts": reasoning.facts_about(F.col("facts"), F.col("names"))})
    return reasoning.reason(about, "direct").select(F.col("qid").alias("query"), "results", "entities", "relations", "answer", "confidence")


STRATEGIES = {"vector_only": vector_only, "graph_only": graph_only, "hybrid": hybrid, "multi_hop": multi_hop, "cascade": cascade, "iterative": iterative}


def search(spark: SparkSession, sources: dict[str, Source], query: str, limit: int = 10) -> DataFrame:
    """Classify the query, then run the plan of its strategy."""
    from siltstone.operators.classify import classify

    plan = classify(spark.createDataFrame([(query,)], "query string")).select("strategy").first()[0]
    return STRATEGIES[plan](spark, sources, query, limit)


def standard_sources(spark: SparkSession, folder: str) -> dict[str, Source]:
    from siltstone.sources import tables

    return {"docs": docs_source(tables.docs(spark, folder)), "code": events_source(tables.events(spark, folder)), "graph": graph_source(tables.nodes(spark, folder), tables.edges(spark, folder))}


def entity_search(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 2, limit: int = 20) -> DataFrame:
    """Neighbours of the entities of that name, nearest first."""
    near = graph.neighbourhood(nodes.where(F.col("name") == name).select("id"), edges, depth)
    return near.join(nodes.select(F.col("id").alias("node"), "name", "type"), "node").orderBy("distance", "node").limit(limit)
