"""Questions, knowledge and tooling by cases by hand, where the test tables hold few or none."""

import pytest

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import knowledge, tooling


def test_query_entity(spark):
    cases = {"find all callers of parse": "parse", "who imports yaml": "yaml", "the reader class": "reader", "entities related to billing": "billing", "open ledger": "ledger", "one two three four": None}
    rows = spark.createDataFrame([(q,) for q in cases], "query string")
    assert {r["query"]: r["e"] for r in rows.select("query", text.query_entity(F.col("query")).alias("e")).collect()} == cases


def test_resolve(spark):
    asked = ["Design a REST api on Kyma", "why is spring broken", "migrate to powerapps", "make it faster", "what is jwt", "hello", None, ""]
    rows = spark.createDataFrame([(q,) for q in asked], "query string")
    got = knowledge.match_patterns(knowledge.resolve(rows), {"gateway": ["api", "rest"], "plain": []}).collect()
    by = {r["query"]: r for r in got}
    assert [by[q]["intent"] for q in asked] == ["design", "troubleshoot", "migrate", "optimize", "explain", "analyze", "analyze", "analyze"]
    assert [by[q]["platform"] for q in asked] == ["sap", "tanzu", "powerplatform", None, None, None, None, None]
    assert [(m["pattern"], m["score"]) for m in by[asked[0]]["matches"]] == [("gateway", 0.7), ("plain", 0.3)]
    assert by["hello"]["matches"] == [] and by[None]["matches"] == []


def test_scan_of_nothing(spark):
    nodes = spark.createDataFrame([], "type string, id string, name string, platform string, seq long")
    assert knowledge.scan("nothing named", nodes, {}).collect() == []
    assert knowledge.scan("aws", nodes, {}).collect() == []


def test_tooling_filters(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0], "Pod"), (2, "b", [1.0, 0.0], "Job")], "id long, content string, embedding array<double>, kind string")
    assert [r["id"] for r in tooling.scan(rows, "kubernetes", [1.0, 0.0], kind="Job").collect()] == [2]
    assert [r["id"] for r in tooling.scan(rows, "kubernetes", [1.0, 0.0], kind=None).collect()] == [1, 2]
    with pytest.raises(ValueError):
        tooling.scan(rows, "helm", [1.0, 0.0], kind="Job")
    with pytest.raises(ValueError):
        tooling.scan(rows, "nowhere", [1.0, 0.0])
    assert [r["id"] for r in tooling.search({"kubernetes": rows}, [], [1.0, 0.0]).collect()] == ["1", "2"]


def test_log_line_without_labels(spark):
    lines = spark.sql("select 1 as id, timestamp '2024-01-01' as ts, cast(null as map<string, string>) as labels, 'm' as message union all select 2, timestamp '2024-01-02', map('service', 's'), 'n'")
    assert [(r["id"], r["level"], r["service"]) for r in tooling.log_range(lines, {}).collect()] == [(2, "info", "s"), (1, "info", "unknown")]
    assert tooling.log_range(lines, {"service": "other"}).count() == 0


def test_element_f1_of_one_side(spark):
    a, none = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y")], "key string, kind string"), spark.createDataFrame([], "key string, kind string")
    assert [tuple(r) for r in tooling.element_f1(a, none).collect()] == [("p", 0.0, 0.0, 0.0)]
    assert [tuple(r) for r in tooling.element_f1(a, a).collect()] == [("p", 1.0, 1.0, 1.0)]
    assert tooling.element_f1(none, none).collect() == []
