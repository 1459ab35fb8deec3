"""Scans of documents, vectors, events and tickets, ranked with a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def hits(content: Column, query: str) -> Column:
    """How many distinct words of the query the lower-cased content holds."""
    t = F.lower(F.coalesce(content, F.lit("")))
    terms = list(dict.fromkeys(query.lower().split())) or [""]
    return reduce(lambda a, b: a + b, (F.contains(t, F.lit(w)).cast("int") for w in terms))


def keyword_scan(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The first documents, in reading order, with the query or one of its words; ``hits`` is not a rank."""
    held = F.contains(F.lower("content"), F.lit(query.lower()))
    return docs.withColumn("hits", hits(F.col("content"), query)).where(held | (F.col("hits") > 0)).orderBy("seq").limit(limit)


def ranked_scan(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Documents by how many words of the query they hold, ties in reading order."""
    n = max(1, len(set(query.lower().split())))
    return docs.withColumn("score", hits(F.col("content"), query) / F.lit(float(n))).where("score > 0").orderBy(F.desc("score"), "seq").limit(limit)


def get(rows: DataFrame, value: object, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) == value).orderBy("seq").limit(1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_scan(rows: DataFrame, query: list[float], limit: int | None = 10, threshold: float | None = None, filters: dict[str, object] | None = None, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The nearest rows by cosine; filters come before scores, the limit is a top-k, and without one all rows are given in no order."""
    for name, value in (filters or {}).items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    out = rows.withColumn("score", cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))))
    out = out if threshold is None else out.where(F.col("score") >= threshold)
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def max_sim(query_vectors: Column, doc_vectors: Column) -> Column:
    """Late interaction: for each query vector its best product with a document vector, summed."""
    best = lambda q: F.array_max(F.transform(doc_vectors, lambda d: dot(q, d)))
    return F.aggregate(F.transform(query_vectors, best), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def flat_max_sim(query: Column, doc_vectors: Column) -> Column:
    """The largest sum of positive products of one query vector with a document vector."""
    positive = lambda d: F.aggregate(F.zip_with(query, d, lambda x, y: F.greatest(F.lit(0.0), x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.array_max(F.transform(doc_vectors, positive))


def search_events(events: DataFrame, query: str = "", service: str | None = None, severity: str | None = None, limit: int = 10, newest: bool = False) -> DataFrame:
    """Events whose message holds the query, in reading order or newest first."""
    out = events.where(F.contains(F.lower("message"), F.lit(query.lower())))
    out = out.where(F.col("service") == service) if service else out
    out = out.where(F.col("severity") == severity) if severity else out
    return out.orderBy(*([F.desc("ts"), "id"] if newest else ["seq"])).limit(limit)


def search_metrics(events: DataFrame, metric: str | None = None, service: str | None = None, limit: int = 10) -> DataFrame:
    out = events.where(F.col("metric_name") == metric) if metric else events
    out = out.where(F.col("service") == service) if service else out
    return out.orderBy("seq").limit(limit)


def search_tickets(tickets: DataFrame, query: str = "", status: str | None = None, priority: str | None = None, limit: int = 10, newest: bool = False) -> DataFrame:
    q = F.lit(query.lower())
    out = tickets.where(F.contains(F.lower("title"), q) | F.contains(F.lower("description"), q))
    out = out.where(F.col("status") == status) if status else out
    out = out.where(F.col("priority") == priority) if priority else out
    return out.orderBy(*([F.desc("created"), "id"] if newest else ["seq"])).limit(limit)


def label_values(rows: DataFrame, label: str) -> DataFrame:
    return rows.select(F.col(label).alias("value")).where("value is not null").distinct()


def first_per_group(rows: DataFrame, group: list[str], n: int, *order: str) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group and task before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def recent(rows: DataFrame, n: int, at: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(at), *ties).limit(n)


def diagram_score(query: Column, entities: Column, ends: Column) -> Column:
    """1 for each entity name in the query, 1/2 for each end of a relation in it."""
    q = F.lower(query)
    count = lambda names: F.size(F.filter(names, lambda x: F.contains(q, F.lower(x))))
    return count(entities) + 0.5 * count(ends)
