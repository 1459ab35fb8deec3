"""Kinds of diagrams, packed pieces and rows for sinks, case by case."""

from pyspark.sql import functions as F

from siltstone.operators import diagrams
from siltstone.sources import readers


def packed(text, size):
    """Words laid one after another into pieces, in plain Python."""
    out, now, n = [], [], 0
    for word in (text or "").split():
        if now and n + len(word) + 1 > size:
            out.append(" ".join(now))
            now, n = [word], len(word)
        else:
            now.append(word)
            n += len(word) + 1
    return out + [" ".join(now)] if now else [text or ""]


def test_pieces_lose_no_word(spark):
    texts = [None, "", "  ", "one", "a" * 50, "a" * 50 + " b", "b " + "a" * 50 + " c d", "x y z " * 40, "w" * 9 + " " + "v" * 9, "é ü " * 9]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: list(r["p"]) for r in rows.select("id", diagrams.extraction_pieces(F.col("t"), 20).alias("p")).collect()}
    assert got == {k: packed(t, 20) for k, t in enumerate(texts)}


def test_diagram_types(spark):
    cases = {
        "class Order { }\nabstract class Base": "uml_class", "<<component>> A, <<service>> B": "uml_component", "component [] x": "uml_component", "package a::b": "uml_package",
        "actor and use case": "uml_usecase", "participant A activate": "uml_sequence", "C4 person": "c4_context", "a sequence": "uml_sequence", "the container": "c4_container", "nothing here": "unknown",
    }
    rows = spark.createDataFrame([*((t, k) for t, k in cases.items()), (None, "unknown"), ("", "unknown")], "t string, want string")
    assert [(r["t"], r["got"]) for r in rows.select("t", diagrams.diagram_type(F.col("t")).alias("got")).collect()] == [*cases.items(), (None, "unknown"), ("", "unknown")]


def test_sinks_take_nulls(spark):
    rows = spark.createDataFrame([(1, None, "map", None), (2, "c", "map", [("a", None), (None, "x"), ("", "y")])], "doc_id int, content string, diagram_type string, entities array<struct<name: string, type: string>>")
    assert {r["doc_id"]: r["combined_text"] for r in diagrams.diagram_points(rows).collect()} == {1: "", 2: "c. Entities: a, , "}
    assert [(r["id"], r["type"]) for r in diagrams.diagram_nodes(rows).collect()] == [("2:a", "entity")]
    assert diagrams.diagram_points(rows.limit(0)).count() == 0


def test_chunks_without_text_have_no_vectors(spark):
    rows = spark.createDataFrame([(1, "a", 0, [[1.0]]), (2, "", 1, [[1.0]]), (3, None, 2, [[1.0]]), (4, "b", 3, [])], "id int, content string, chunk_index int, vectors array<array<double>>")
    assert [r["id"] for r in diagrams.token_vectors(rows).collect()] == [1]


def test_requirements_from_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("Login\nAcceptance criteria\n- works\n* is fast\nTraceability\n- T1\n")
    (tmp_path / "b.md").write_text("x" * 900)
    got = {r["title"]: (len(r["description"]), r["criteria"]) for r in readers.requirements(readers.texts(spark, str(tmp_path), "*.md")).collect()}
    assert got["a.md"][1] == ["works", "is fast"] and got["b.md"] == (500, [])
