"""Links between texts and entities: entities of chunks, of model output and of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Types of entities in model output; others count as concepts (fixed values).
TYPES = ["person", "organization", "concept", "event", "location", "product", "technology", "document", "process"]
SHAPE = "array<struct<name: string, type: string, description: string>>"


def entities_of_chunks(chunks: DataFrame, found: DataFrame, key: str = "id", most: int = 10) -> DataFrame:
    """(key, chunk, entities): ids of the first ``most`` entities of a source whose names stand in its chunk.

    A join on the source; an entity list has a bounded length a source, see ``extract.entities``.
    """
    named = found.select(key, "ord", "entity_id", F.lower("name").alias("_name"))
    inside = chunks.select(key, "chunk", F.lower("content").alias("_text")).join(named, key).where(F.contains("_text", F.col("_name")))
    first = F.slice(F.array_sort(F.collect_list(F.struct("ord", "entity_id"))), 1, most)
    return inside.groupBy(key, "chunk").agg(F.transform(first, lambda e: e["entity_id"]).alias("entities"))


def parsed_entities(output: Column) -> Column:
    """Entities of a JSON list of objects; anything else, broken JSON too, gives none."""
    given = F.coalesce(output, F.lit(""))
    rows = F.when(F.startswith(F.ltrim(given), F.lit("[")), F.from_json(given, SHAPE))
    kind = lambda e: F.lower(F.coalesce(e["type"], F.lit("concept")))
    known = lambda e: F.when(kind(e).isin(TYPES), kind(e)).otherwise("concept")
    none = F.array().cast("array<struct<name: string, type: string, description: string>>")
    return F.coalesce(F.transform(rows, lambda e: F.struct(F.coalesce(e["name"], F.lit("")).alias("name"), known(e).alias("type"), F.coalesce(e["description"], F.lit("")).alias("description"))), none)


def overlapping(need: DataFrame, have: DataFrame) -> DataFrame:
    """(pattern, owner) that share any element: an equi-join of (pattern, element) and (owner, element)."""
    return need.join(have.distinct(), "element").select("pattern", "owner").distinct()


def linked_entities(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, node, other, type, community): nodes named in each question and what they are connected to.

    questions: qid, names (array). Names are compared in small letters; ``community`` tells
    edges whose type speaks of one. A node without edges has one row with nulls.
    """
    names = questions.select("qid", F.explode(F.array_distinct(F.transform("names", F.lower))).alias("_name"))
    found = names.join(nodes.select(F.col("id").alias("node"), F.lower("name").alias("_name")), "_name").select("qid", "node")
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type"))
    return found.join(ends, "node", "left").select("qid", "node", "other", "type", F.contains(F.lower("type"), F.lit("community")).alias("community"))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of each node that has an edge: one shuffle of partial counts."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def page_of(nodes: DataFrame, types: list[str] | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a listing of nodes or edges in order of their ids."""
    kept = nodes.where(F.col("type").isin(types)) if types else nodes
    return kept.orderBy(*(c for c in ("id", "src", "dst", "type") if c in nodes.columns)).offset(offset).limit(limit)
