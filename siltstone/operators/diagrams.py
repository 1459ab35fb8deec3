"""Diagrams and prepared rows: what kind a text is, and the rows that sinks of vectors and graphs take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Signs of each type of diagram; two of them make the type, in this order (fixed values).
TYPE_SIGNS = {
    "uml_class": [r"class\s+\w+", r"^\+\w+\(\)", r"-\w+\(\)", r"#\w+\(\)", r"<<\w+>>", "interface", "abstract"],
    "uml_component": ["<<component>>", "<<service>>", "<<library>>", r"\[\]", "component", "provided interface", "required interface"],
    "uml_package": ["package", "folder", "namespace", "::", "package"],
    "uml_deployment": ["node", "artifact", "deployment", "server", "database", "execution environment", "device"],
    "uml_object": ["object", ":", "instance", r":\w+\(\)"],
    "uml_usecase": ["actor", "use case", "ellipse", "stick figure", "system boundary"],
    "uml_sequence": ["lifeline", "participant", "activate", "deactivate", "->>", "-->", "loop", "alt", "opt", "ref"],
    "c4_context": ["c4", "context", "person", "external system", "software system", "context"],
    "c4_container": ["c4", "container", "database", "service", "app", "spa", "container"],
    "c4_component": ["c4", "component", "inside container"],
}
#: Words that tell a type where no two signs do: all words, type (fixed values).
TYPE_WORDS = [(["sequence"], "uml_sequence"), (["class", "diagram"], "uml_class"), (["c4"], "c4_container"), (["container"], "c4_container")]
UNKNOWN = "unknown"
#: Beginnings of Mermaid texts, whose type is told by their content (fixed values).
MERMAID = ["graph", "flowchart", "sequenceDiagram", "classDiagram"]
MOST_TEXT, MOST_NAMES, MOST_NODE_TEXT = 2000, 10, 200


def diagram_type(text: Column) -> Column:
    """The first type with two signs in the text, else the first whose words stand in it; null is unknown."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(UNKNOWN)
    for words, kind in reversed(TYPE_WORDS):
        held = F.lit(True)
        for w in words:
            held = held & F.contains(t, F.lit(w))
        out = F.when(held, kind).otherwise(out)
    for kind, signs in reversed(TYPE_SIGNS.items()):
        count = F.lit(0)
        for sign in signs:
            count = count + F.rlike(t, F.lit("(?U)" + sign)).cast("int")
        out = F.when(count >= 2, kind).otherwise(out)
    return out


def diagram_format(text: Column, name: Column) -> Column:
    """drawio, plantuml, bpmn, openapi or unknown, by the file's ending and then by its content.

    A text is BPMN if it speaks of it and of a process or of definitions.
    """
    t, n = F.trim(F.coalesce(text, F.lit(""))), F.coalesce(name, F.lit(""))
    ends = lambda *e: F.rlike(n, F.lit(r"\.(?:" + "|".join(e) + r")$"))
    process = F.contains(t, F.lit("bpmn")) & (F.contains(t, F.lit("process")) | F.contains(t, F.lit("definitions")))
    described = F.startswith(t, F.lit("{")) & F.coalesce(F.get_json_object(t, "$.openapi"), F.get_json_object(t, "$.swagger")).isNotNull()
    mermaid = F.rlike(t, F.lit("^(?:" + "|".join(MERMAID) + ")")) | F.contains(t, F.lit("%%{ mermaid }%%"))
    return (
        F.when(ends("drawio", "dio"), "drawio")
        .when(ends("puml", "plantuml"), "plantuml")
        .when(ends("mmd", "mermaid"), UNKNOWN)
        .when(ends("bpmn", "xml") & process, "bpmn")
        .when(described, "openapi")
        .when(F.startswith(t, F.lit("@startuml")), "plantuml")
        .when(mermaid, UNKNOWN)
        .when(F.contains(t, F.lit("<mxfile")) | F.contains(t, F.lit('xmlns="http://www.drawio.com')), "drawio")
        .when(process, "bpmn")
        .when(F.startswith(t, F.lit("{")) | F.startswith(t, F.lit("openapi:")), "openapi")
        .otherwise(UNKNOWN)
    )


def diagram_points(diagrams: DataFrame) -> DataFrame:
    """Rows of a vector sink from (doc_id, content, diagram_type, entities: array<struct<name, type>>).

    ``combined_text``, which is embedded, adds the first ten entity names to the content; both
    texts are cut at 2,000 characters, as the sink stores them.
    """
    names = F.array_join(F.transform(F.slice("entities", 1, MOST_NAMES), lambda e: F.coalesce(e["name"], F.lit(""))), ", ")
    content = F.coalesce("content", F.lit(""))
    both = F.when(F.coalesce(F.size("entities"), F.lit(0)) > 0, F.concat(content, F.lit(". Entities: "), names)).otherwise(content)
    return diagrams.select("doc_id", "diagram_type", F.substring(content, 1, MOST_TEXT).alias("content"), F.substring(both, 1, MOST_TEXT).alias("combined_text"))


def diagram_nodes(diagrams: DataFrame) -> DataFrame:
    """(id, type, properties) of the named entities of diagrams, as ``graph.merge_nodes`` takes them; the id is document:name."""
    e = diagrams.select("doc_id", "diagram_type", F.explode("entities").alias("e")).where(F.coalesce("e.name", F.lit("")) != "")
    properties = F.create_map(F.lit("name"), F.col("e.name"), F.lit("diagram_type"), F.col("diagram_type"), F.lit("doc_id"), F.col("doc_id").cast("string"))
    return e.select(F.concat_ws(":", F.col("doc_id").cast("string"), "e.name").alias("id"), F.coalesce("e.type", F.lit("entity")).alias("type"), properties.alias("properties"))


def design_index(nodes: DataFrame) -> DataFrame:
    """Rows of the index of design nodes (id, content, artifact_type): text to embed, type and new status."""
    text = F.concat(F.col("id").cast("string"), F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, MOST_NODE_TEXT))
    return nodes.select("id", text.alias("text"), F.coalesce("artifact_type", F.lit(UNKNOWN)).alias("artifact_type"), F.lit("INDEXED").alias("status"))


def token_vectors(chunks: DataFrame, source_id: str = "default", source_type: str = "document", kind: str = "float") -> DataFrame:
    """Chunks (id, content, chunk_index, vectors) with several vectors each, of numbers of a ``kind``, as late interaction reads them; empty ones are left out."""
    kept = chunks.where((F.coalesce("content", F.lit("")) != "") & (F.size("vectors") > 0))
    return kept.select("id", "content", "chunk_index", F.lit(source_id).alias("source_id"), F.lit(source_type).alias("source_type"), F.col("vectors").cast(f"array<array<{kind}>>").alias("vectors"))


def extraction_pieces(text: Column, size: int = 8000) -> Column:
    """Words packed into pieces of at most ``size`` characters, for a model that extracts.

    A word longer than that is a piece of its own and never dropped. A text without words is one
    piece, itself; null is one empty piece. Every word counts with a space but for the first of
    a later piece.
    """
    given = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(given, r"(?U)\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def add(a: Column, w: Column) -> Column:
        full = (a["n"] + F.length(w) + 1 > size) & (F.size(a["now"]) > 0)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(w)).otherwise(F.concat(a["now"], F.array(w))).alias("now"),
            F.when(full, F.length(w)).otherwise(a["n"] + F.length(w) + 1).alias("n"),
        )

    packed = F.aggregate(words, start, add, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"]))
    return F.when(F.size(words) == 0, F.array(given)).otherwise(packed)
