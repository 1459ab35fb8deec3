"""Queries read their whole tables, without caps."""

import pytest
from pyspark.sql import functions as F

from siltstone import queries
from siltstone.operators import telemetry
from siltstone.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_half_average_equals_the_fold_and_gathers_nothing(spark):
    rows = [(k, n, float((n * 37 + k) % 101)) for k in range(5) for n in range(1 + 400 * (k == 4) + k)] + [(9, 0, 1.0), (9, 1, None)]
    df = spark.createDataFrame(rows, "k long, o long, v double")
    got = telemetry.running_half_average(df, "k", "v", "o")
    want = {}
    for k, _, v in rows:
        want[k] = None if v is None else (want.get(k, 0.0) + v) / 2
    assert {r["k"]: r["average"] for r in got.collect()} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    assert "collect_list" not in plan(got)


def test_running_average_has_every_customer(spark):
    got = {r["customer"]: r["average"] for r in queries.QUERIES["running_average_all"](spark, FOLDER).collect()}
    want = {}
    for r in tables.read(spark, FOLDER, "orders").orderBy("o_orderdate", "o_orderkey").collect():
        want[r["o_custkey"]] = (want.get(r["o_custkey"], 0.0) + float(r["o_totalprice"])) / 2
    assert got == {k: pytest.approx(v, abs=1e-3) for k, v in want.items()} and max(got) > 50


def test_components_of_the_whole_graph(spark):
    got = {r["id"]: r["community"] for r in queries.QUERIES["connected_components_all"](spark, FOLDER).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for e in tables.edges(spark, FOLDER).collect():
        a, b = sorted((find(e["src"]), find(e["dst"])))
        root[b] = a
    assert got == {x: find(x) for x in root} and any(x.startswith("customer:") for x in got)


def test_vector_filter_has_no_limit(spark):
    assert "Limit" not in plan(queries.QUERIES["vector_filtered"](spark, FOLDER)).split("== Optimized Logical Plan ==")[1]


def test_cooccurrence_reads_every_document_as_it_is(spark, tmp_path):
    docs = tables.read(spark, FOLDER, "documents").limit(0)
    own = spark.createDataFrame([(5, "nothing here"), (70_000, "Docker runs next to Kubernetes")], "doc_id long, text string")
    own.select(*(F.col(c) if c in own.columns else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes)).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["id"], r["a"], r["b"], r["count"]) for r in queries.QUERIES["cooccurrence"](spark, str(tmp_path)).collect()]
    assert got == [(70_000, "Docker", "Kubernetes", 1)]


def test_scratch_tables_go(spark):
    import os

    from siltstone.operators import graph
    from siltstone.storage import scratch, shared_folder

    edges = spark.createDataFrame([("a", "b", "T"), ("b", "c", "T"), ("c", "d", "T")], "src string, dst string, type string")
    seeds = spark.createDataFrame([("a",)], "id string")
    steps = lambda: {f for f in os.listdir(shared_folder(spark).removeprefix("file://").removeprefix("file:")) if f.startswith("step-")}
    before = steps()
    with scratch(spark):
        assert {r["node"] for r in graph.neighbourhood(seeds, edges, 3).collect()} == {"b", "c", "d"}
        assert steps() > before
    assert steps() == before


def test_callbacks_hear_of_batches_and_may_fail(spark):
    from siltstone.streaming import ingest

    heard, logged, stored = [], [], []

    def fails(source, batch):
        raise ValueError("no")

    hears = lambda source, batch: heard.append((source, batch.count()))
    run = ingest.notifying(lambda b, n: stored.append(n), [fails, hears, hears], "docs", logged.append)
    run(spark.range(3), 7)
    assert stored == [7] and heard == [("docs", 3)] and logged == ["a callback failed for source docs: no"]


def test_components_of_one_id_become_one(spark):
    from siltstone.operators import graph

    schema = "id string, type string, properties map<string,string>"
    nodes = spark.createDataFrame([("a", "old", {"x": "1", "y": "2"})], schema)
    new = spark.createDataFrame([("a", "db", {"y": "3"}), ("a", "cache", {"z": "4"}), ("b", "api", None), (None, "none", {"q": "1"})], schema)
    edges = spark.createDataFrame([("a", "b", "USES"), ("a", "b", "USES"), ("a", "q", "USES")], "src string, dst string, type string")
    after, kept = graph.merge_architecture(nodes, edges.limit(0), new, edges)
    assert {r["id"]: (r["type"], r["properties"]) for r in after.collect()} == {"a": ("db", {"x": "1", "y": "3", "z": "4"}), "b": ("api", {})}
    assert [tuple(r) for r in kept.select("src", "dst", "type").collect()] == [("a", "b", "USES")]
