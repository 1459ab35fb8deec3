"""Caches, joined telemetry and the landing source: streams equal batch and step-by-step replays."""

import json
import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone import queries_reasoning
from siltstone.operators import graph, reasoning
from siltstone.sources import landing, tables
from siltstone.streaming import caches, ingest

OPS = "cache string, id long, at double, op string, key string, value string"


def step_by_step(rows, capacity, ttl):
    """One operation after the other on ordered dictionaries."""
    held, out = {}, {}
    for cache, i, at, op, key, value in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        c, at, hit, got = held.setdefault(cache, OrderedDict()), at or 0.0, None, None
        if key is None or op not in caches.OPS:
            pass
        elif op in ("get", "look"):
            hit = key in c and at - c[key][0] <= ttl
            if hit:
                c.move_to_end(key)
                got = c[key][1]
            else:
                c.pop(key, None)
                if op == "look":
                    if len(c) >= capacity:
                        c.popitem(last=False)
                    c[key] = (at, value)
                    got = value
        elif op == "put":
            if key not in c and len(c) >= capacity:
                c.popitem(last=False)
            c[key] = (at, value)
            c.move_to_end(key)
            got = value
        else:
            going = [k for k in c if k == key or op == "drop_prefix" and k.startswith(key)]
            for k in going:
                del c[k]
            hit = bool(going)
        out[i] = (hit, got, len(c))
    return out


def operations(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), k, float(k + rng.randint(0, 3)), rng.choices(["get", "put", "look", "drop", "drop_prefix", "odd"], [8, 5, 8, 1, 1, 1])[0], rng.choice(["x", "y", ""]) + str(rng.randint(0, 12)), f"v{k}") for k in range(n)]
    return rows + [("a", n, None, "put", "early", "v"), ("a", n + 1, 5.0, "get", None, None)]


def test_replayed_caches(spark):
    rows = operations(800, 1)
    df = spark.createDataFrame(rows, OPS).withColumn("hit", F.lit("clash")).repartition(3)
    got = {r["id"]: (r["hit"], r["value"], r["size"]) for r in caches.replay(df, 6, 40.0).collect()}
    assert got == step_by_step(rows, 6, 40.0) and {h for h, _, _ in got.values()} == {True, False, None}
    assert caches.replay(df.limit(0)).count() == 0


def test_caches_as_a_stream(spark, tmp_path):
    rows = operations(300, 2)
    before = spark.conf.get(caches.STORE[0])
    spark.conf.set(*caches.STORE)
    try:
        for part in range(3):  # operations of a later file are later
            mine = [r for r in rows if (r[2] or 0) // 110 == part]
            spark.createDataFrame(mine, OPS).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
        stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
        q = caches.cache_stream(stream, 6, 40.0).writeStream.format("memory").queryName("cached").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        got = {r["id"]: (r["hit"], r["value"], r["size"]) for r in spark.table("cached").collect()}
    finally:
        spark.conf.set(caches.STORE[0], before)
    assert got == step_by_step(rows, 6, 40.0)


def test_cache_queries(spark):
    folder = "/root/testdata/sf0.001"
    e = tables.events(spark, folder).collect()
    rows = [(r["user_id"], r["id"], r["ts"].timestamp(), "look", str(r["k"]) if r["k"] is not None else None, r["metric_name"]) for r in e]
    got = {r["id"]: (r["hit"], r["value"], r["size"]) for r in queries_reasoning.cache_replayed(spark, folder).collect()}
    want = step_by_step(rows, 20, 172_800.0)
    assert got == want
    rates = queries_reasoning.cache_hit_rates(spark, folder).collect()
    assert sum(r["hits"] for r in rates) == sum(h is True for h, _, _ in want.values()) > 0


LOGS, METRICS = "id long, ts timestamp, service string, message string", "id long, ts timestamp, service string, metric_name string, value double"
T0 = datetime(2024, 1, 1)


def telemetry(seed):
    rng = random.Random(seed)
    at = lambda part: T0 + timedelta(seconds=part * 600 + rng.randint(0, 599))
    logs = [[(100 * p + k, at(p), rng.choice(["a", "b", None]), "m") for k in range(40)] for p in range(4)]
    metrics = [[(100 * p + k, at(p), rng.choice(["a", "b"]), "cpu", float(k)) for k in range(40)] for p in range(4)]
    logs[3].append((999, T0 + timedelta(seconds=5), "a", "far too late"))
    logs[0].append((998, None, "a", "no time"))
    return logs, metrics


def pairs(df):
    return sorted((r["log_id"], r["metric_id"], r["service"]) for r in df.collect())


def test_telemetry_pairs_as_a_stream(spark, tmp_path):
    logs, metrics = telemetry(1)
    for p in range(4):
        spark.createDataFrame(logs[p], LOGS).coalesce(1).write.parquet(str(tmp_path / "logs"), mode="append")
        spark.createDataFrame(metrics[p], METRICS).coalesce(1).write.parquet(str(tmp_path / "metrics"), mode="append")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    joined = ingest.telemetry_pairs(read("logs", LOGS), read("metrics", METRICS), late="5 minutes")
    q = joined.writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    on_time = spark.createDataFrame([r for p in logs for r in p if r[0] != 999], LOGS)
    every = spark.createDataFrame([r for p in metrics for r in p], METRICS)
    want = pairs(ingest.telemetry_pairs(on_time, every, late=None))
    assert pairs(spark.table("joined")) == want and len(want) > 20
    assert ingest.dropped_rows(q) >= 1
    assert pairs(ingest.bucketed_pairs(on_time, every, 30)) == want


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=s), float(s)) for s in (0, 299, 300, 601, 5000)]
    spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = ingest.windowed(stream).writeStream.format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r["start"], r["n"], r["total"]) for r in spark.table("windowed").collect()) == [(T0, 2, 299.0), (T0 + timedelta(seconds=300), 1, 300.0), (T0 + timedelta(seconds=600), 1, 601.0), (T0 + timedelta(seconds=4800), 1, 5000.0)]


LANDED = "id long, service string, severity string, message string, ts timestamp, value double"


@pytest.fixture
def landed(spark, tmp_path):
    rng = random.Random(4)
    for page in range(6):
        service = f"svc{page % 2}"
        with open(tmp_path / f"service={service},page={page}.json", "w") as f:
            for k in range(20):
                row = {"id": page * 100 + k, "service": service, "severity": rng.choice(["info", "critical", None]), "message": rng.choice(["disk full", "ok é", "timeout"]), "ts": (T0 + timedelta(minutes=page * 20 + k)).isoformat(), "value": rng.random()}
                f.write(json.dumps({k: v for k, v in row.items() if v is not None}) + "\n\n")
    landing.register(spark)
    return str(tmp_path)


def test_landing_equals_a_plain_read(spark, landed):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    plain = spark.read.schema(LANDED).json(landed)
    mine = spark.read.format(landing.NAME).schema(LANDED).load(landed)
    assert rows(mine) == rows(plain) and mine.count() == 120
    for condition in ("service = 'svc1'", "severity is null", "severity = 'critical' and value > 0.5", "message like '%full%' and value <= 0.9", "severity <=> null", "id in (1, 305)", "ts >= timestamp'2024-01-01 01:00:00'", "not (value < 0.2)", "length(message) > 5", "service = 'none'"):
        assert rows(mine.where(condition)) == rows(plain.where(condition)), condition


def test_landing_pushes_filters_and_skips_pages(spark, landed):
    backend = landing.FolderBackend({"path": landed})
    reader = landing.LandingReader(backend, spark.read.schema(LANDED).json(landed).schema)
    assert list(reader.pushFilters([landing.EqualTo(("service",), "svc1"), landing.EqualTo(("a", "b"), 1)])) == [landing.EqualTo(("a", "b"), 1)]
    assert [p.page for p in reader.partitions()] == [f"service=svc1,page={n}.json" for n in (1, 3, 5)]
    df = spark.read.format(landing.NAME).schema(LANDED).load(landed).where("service = 'svc1' and length(message) > 5")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "svc1" in plan[plan.index("BatchScan") :] and "PushedFilters" in plan
    after = plan[plan.index("Filter") :]
    assert "length" in after


def test_landing_as_a_stream(spark, landed, tmp_path_factory):
    stream = spark.readStream.format(landing.NAME).schema(LANDED).load(landed)
    q = stream.writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path_factory.mktemp("c"))).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r["id"] for r in spark.table("landed").collect()} == {r["id"] for r in spark.read.schema(LANDED).json(landed).collect()}


def depth_first(start, edges, hops, fan, within):
    def walk(node, seen, depth):
        if depth >= hops or node in seen:
            return []
        out = [node]
        if within is None or node in within:
            for b in sorted(b for a, b in edges if a == node)[:fan]:
                out += walk(b, [*seen, node], depth + 1)
        return out[:hops]

    return walk(start, [], 0)


@pytest.mark.parametrize("hops,fan", [(3, 3), (1, 3), (4, 2), (5, 3)])
def test_traversals(spark, hops, fan):
    rng = random.Random(hops)
    names = [f"n{k}" for k in range(15)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [("hub", f"m{k:03}") for k in range(300)] + [("n1", "hub"), ("n2", "n2")]
    e = spark.createDataFrame([(a, b, "T") for a, b in edges], "src string, dst string, type string")
    seeds = spark.createDataFrame([(n,) for n in [*names, "hub", "alone", "alone", None]], "id string")
    for within in (None, ["n1", "n3", "hub"]):
        given = None if within is None else spark.createDataFrame([(n,) for n in within], "id string")
        got = {r["start"]: r["nodes"] for r in graph.traversals(seeds, e, hops, fan, within=given).collect()}
        assert got == {s: depth_first(s, edges, hops, fan, within) for s in [*names, "hub", "alone"]}
    near = graph.first_neighbours(e).where("a = 'hub'").collect()
    assert sorted(r["b"] for r in near) == ["m000", "m001", "m002"]


def test_entity_aware_reasoning(spark):
    fact = "array<struct<rank:int,content:string,source:string,score:double>>"
    asked = [(1, "Does Alpha, call Beta?", [(1, "alpha runs", "docs", 0.4), (2, "nothing", "code", 0.9), (3, None, "x", None)]), (2, "no names here", [(1, "only", "docs", 0.5)]), (3, "What is Gamma", None), (4, None, [])]
    e = spark.createDataFrame([("Alpha", "Beta", "T"), ("Beta", "Core", "T"), ("Beta", "Alpha", "T"), ("Gamma", "Alpha", "T")], "src string, dst string, type string")
    got = {r["qid"]: r for r in reasoning.entity_aware(spark.createDataFrame(asked, f"qid long, query string, facts {fact}"), e).collect()}
    assert got[1]["entities"] == ["Alpha", "Beta", "Does"]
    assert {p["entity"]: p["nodes"] for p in got[1]["paths"]} == {"Alpha": ["Alpha", "Beta", "Core"], "Beta": ["Beta", "Alpha", "Core"]}
    assert got[1]["answer"] == "alpha runs" and got[1]["confidence"] == pytest.approx(min(1, 0.4 + 3 * 0.2)) and got[1]["sources"] == ["docs"]
    assert [(s["step_id"], s["action"], s["observation"]) for s in got[1]["steps"]] == [("0", "analyze", "Identified 2 graph paths"), ("1", "traverse", "Path length: 3"), ("2", "traverse", "Path length: 3")]
    assert got[2]["paths"] == [] and got[2]["confidence"] == 0.5 and got[2]["answer"] == "only"
    # Alpha is no entity of the third question and leads no further
    assert {p["entity"]: p["nodes"] for p in got[3]["paths"]} == {"Gamma": ["Gamma", "Alpha"]}
    assert got[3]["answer"] == reasoning.NOTHING and got[3]["confidence"] == pytest.approx(0.4)
    assert got[4]["answer"] == reasoning.NOTHING and got[4]["entities"] == [] and got[4]["confidence"] == 0.0
