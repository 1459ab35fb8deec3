"""Scans of tooling collections and of logs, and plans over several collections."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators import fusion, retrieval

#: Collections and the columns that a scan of each may compare (fixed values).
FILTERS = {
    "code": ["language"],
    "kubernetes": ["kind", "namespace", "entity_type"],
    "helm": ["chart_name", "version", "entity_type"],
    "dockerfile": ["instruction", "base_image", "entity_type"],
    "graphql": ["kind", "type_name", "entity_type"],
    "istio": ["kind", "namespace", "hosts", "entity_type"],
}
#: The collection that is read if none is named, and the level of a log line without one (fixed values).
OTHERWISE, LEVEL = "kubernetes", "info"
#: Chunkers by ending or whole name of a file, and words in a path that tell Istio (fixed values).
CHUNKER_OF = {
    "code": ["py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "kt", "kts", "c", "cpp", "h", "hpp"],
    "sentence": ["txt", "rst"],
    "kubernetes": ["yaml", "yml"],
    "helm": ["helm", "tpl"],
    "graphql": ["graphql", "gql"],
}
ISTIO_WORDS = ["virtualservice", "destinationrule", "serviceentry", "envoyfilter", "authorizationpolicy", "sidecar"]


def scan(rows: DataFrame, collection: str, query: list[float], limit: int = 10, **equal: object) -> DataFrame:
    """The nearest rows of a collection; filters come before scores."""
    if collection not in FILTERS:
        raise ValueError(f"collection must be one of {', '.join(FILTERS)}")
    if unknown := set(equal) - set(FILTERS[collection]):
        raise ValueError(f"{collection} has no filter {', '.join(sorted(unknown))}")
    return retrieval.vector_scan(rows, query, limit, filters=equal)


def search(collections: dict[str, DataFrame], named: list[str], query: list[float], limit: int = 10) -> DataFrame:
    """The named collections scanned and fused by rank; one that is missing is empty."""
    w = Window.orderBy(F.desc("score"), "id")  # over at most ``limit`` rows
    parts = []
    for name in FILTERS:
        if name in (named or [OTHERWISE]) and name in collections:
            found = scan(collections[name], name, query, limit)
            parts.append(found.select(F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), "content", "score", F.row_number().over(w).cast("long").alias("seq")))
    if not parts:
        raise ValueError("none of the named collections is there")
    return fusion.top(fusion.rrf(reduce(DataFrame.unionByName, parts)), limit, "fused_score", "source", "id")


def until_enough(found: DataFrame, limit: int, branch: str = "branch") -> DataFrame:
    """Rows of branches in order until they hold ``limit`` rows; the branch that reaches it is kept whole.

    Branches are few, so the running count is a window over one row a branch.
    """
    sizes = found.groupBy(branch).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(branch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(sizes.withColumn("_before", before).where(F.col("_before") < limit).select(branch), branch, "left_semi")


def log_range(lines: DataFrame, selector: dict[str, str], start: datetime | None = None, end: datetime | None = None, limit: int = 100) -> DataFrame:
    """The newest log lines (id, ts, labels, message) of a stream in [start, end), with level and service from their labels."""
    out = lines
    for name, value in selector.items():
        out = out.where(F.col("labels")[name] == value)
    out = out if start is None else out.where(F.col("ts") >= F.lit(start))
    out = out if end is None else out.where(F.col("ts") < F.lit(end))
    label = lambda n: F.coalesce(F.col("labels")[n], F.lit(LEVEL if n == "level" else "unknown"))
    return out.orderBy(F.desc("ts"), "id").limit(limit).select("id", "ts", label("level").alias("level"), label("service").alias("service"), "message")


def chunker_of(path: Column) -> Column:
    """The chunker for a file by its name."""
    p = F.lower(F.coalesce(path, F.lit("")))
    end = F.regexp_extract(p, r"\.([^./]+)$", 1)
    kind = F.lit("semantic")
    for name, ends in CHUNKER_OF.items():
        kind = F.when(end.isin(ends), name).otherwise(kind)
    about = reduce(lambda a, b: a | b, (F.contains(p, F.lit(w)) for w in ISTIO_WORDS)) | (F.contains(p, F.lit("gateway")) & F.contains(p, F.lit("istio")))
    return F.when(F.rlike(p, F.lit(r"(^|/)dockerfile$")), "dockerfile").when((kind == "semantic") & about, "istio").otherwise(kind)


def element_f1(found: DataFrame, expected: DataFrame, key: str = "key", kind: str = "kind") -> DataFrame:
    """(key, precision, recall, f1) of the kinds that are there for each key of either side; 0 where a side is empty."""
    a = found.select(key, kind).distinct().withColumn("_a", F.lit(1))
    b = expected.select(key, kind).distinct().withColumn("_b", F.lit(1))
    g = a.join(b, [key, kind], "full").groupBy(key).agg(F.count("_a").alias("a"), F.count("_b").alias("b"), F.sum(F.col("_a") * F.col("_b")).alias("both"))
    both = F.coalesce("both", F.lit(0)).cast("double")
    share = lambda n: F.when(F.col(n) > 0, both / F.col(n)).otherwise(0.0)
    return g.select(key, share("a").alias("precision"), share("b").alias("recall"), (2.0 * both / (F.col("a") + F.col("b"))).alias("f1"))
