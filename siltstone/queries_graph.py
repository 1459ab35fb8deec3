"""Queries of architectures in the graph, related and depending nodes, drawings as text, and normalised telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import code, drawings, extract, graph, reasoning
from siltstone.plans import retrieve
from siltstone.queries import DOCS, EVENTS, hits_sql, query, r6
from siltstone.queries_layout import DRAWN, user_drawings
from siltstone.queries_reasoning import TURNS, answered_turns, supplier_code
from siltstone.sources import tables
from siltstone.streaming import ingest


def supplier_nodes(spark, d):
    """Suppliers as nodes whose properties say the nation."""
    s = tables.read(spark, d, "supplier")
    return s.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("type"), F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("name"), F.col("s_name")).alias("properties"))


ARCHITECTURE = """n0 as (select 'supplier:' || s_suppkey as id, 'supplier' as type, 'nation' as k, cast(s_nationkey as varchar) as v from supplier union all select 'supplier:' || s_suppkey, 'supplier', 'name', s_name from supplier),
n1 as (select 'supplier:' || (l_suppkey * 2) as id, 'component' as type, 'parts' as k, cast(count(*) as varchar) as v from lineitem group by l_suppkey union all select 'supplier:' || (l_suppkey * 2), 'component', 'name', 'Component ' || (l_suppkey * 2) from lineitem group by l_suppkey),
ids as (select coalesce(a.id, b.id) as id, coalesce(b.type, a.type) as type from (select distinct id, type from n0) a full join (select distinct id, type from n1) b on a.id = b.id),
props as (select coalesce(a.id, b.id) as id, coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v from n0 a full join n1 b on a.id = b.id and a.k = b.k)"""


def components(spark, d):
    """Components of twice the key of each supplier with lines: one half of them are suppliers known already."""
    g = tables.read(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 2).alias("k")).agg(F.count("*").alias("n"))
    k = F.col("k").cast("string")
    return g.select(F.concat(F.lit("supplier:"), k).alias("id"), F.lit("component").alias("type"), F.create_map(F.lit("parts"), F.col("n").cast("string"), F.lit("name"), F.concat(F.lit("Component "), k)).alias("properties"))


def relationships(spark, d):
    """Each component depends on the one of half its key; some ends are unknown."""
    k = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return k.select(F.concat(F.lit("supplier:"), (F.col("k") * 2).cast("string")).alias("src"), F.concat(F.lit("supplier:"), (F.col("k") * 3).cast("string")).alias("dst"), F.lit("DEPENDS_ON").alias("type"))


def merged_architecture(spark, d):
    none = spark.createDataFrame([], "src string, dst string, type string")
    return graph.merge_architecture(supplier_nodes(spark, d), none, components(spark, d), relationships(spark, d))


@query(f"with {ARCHITECTURE} select ids.id, type, string_agg(k || '=' || v, ',' order by k) as properties from ids join props using (id) group by ids.id, type")
def architecture_nodes(spark, d):
    n = merged_architecture(spark, d)[0]
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return n.select("id", "type", shown.alias("properties"))


@query(f"with {ARCHITECTURE} select distinct 'supplier:' || (s_suppkey * 2) as src, 'supplier:' || (s_suppkey * 3) as dst, 'DEPENDS_ON' as type from supplier where 'supplier:' || (s_suppkey * 2) in (select id from ids) and 'supplier:' || (s_suppkey * 3) in (select id from ids)")
def architecture_edges(spark, d):
    return merged_architecture(spark, d)[1].select("src", "dst", "type")


@query("""with e as (select 'supplier:' || s_suppkey as src, 'supplier:' || (s_suppkey * 2) as dst, case when s_suppkey % 3 = 0 then 'USES' else 'DEPENDS_ON' end as type from supplier),
s as (select src, dst from e union select dst, src from e where type = 'DEPENDS_ON'), seeds as (select 'supplier:' || s_suppkey as id from supplier where s_suppkey % 5 = 0),
w as (select id as start, dst as node, 1 as distance from seeds join s on src = id union all select id, b.dst, 2 from seeds join s a on a.src = id join s b on b.src = a.dst)
select start, node, min(distance)::bigint as distance from w where node <> start group by start, node""")
def related_nodes(spark, d):
    k = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda c: F.concat(F.lit("supplier:"), c.cast("string"))
    e = k.select(name(F.col("k")).alias("src"), name(F.col("k") * 2).alias("dst"), F.when(F.col("k") % 3 == 0, "USES").otherwise("DEPENDS_ON").alias("type"))
    out = graph.related(k.where("k % 5 = 0").select(name(F.col("k")).alias("id")), e, 2)
    return out.select("start", "node", F.col("distance").cast("long").alias("distance"))


@query("select 'module:shop' as name, 'file:src/nation' || s_nationkey || '.py' as other, 'imported by' as how from supplier group by s_nationkey")
def code_dependencies(spark, d):
    """What imports each module and what each method calls, in the code made from suppliers."""
    e = code.code_graph(code.structure(supplier_code(spark, d)))[1]
    return graph.dependencies(e).withColumn("how", F.lit("imported by")).unionByName(graph.usage(e).withColumn("how", F.lit("calls")))


@query(f"""with {TURNS}, w as (select *, list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '') as words from pairs),
a as (select case when query = '' then 0.5 when contains(lower(response), lower(query)) then 1.0 else len(list_filter(words, lambda x: contains(lower(response), x))) / greatest(len(words), 1)::double end as c,
  0.5 + case when contains(lower(query), 'architecture') and (contains(lower(response), 'component') or contains(lower(response), 'service') or contains(lower(response), 'api')) then 0.25 else 0 end + case when contains(lower(response), 'database') or contains(lower(response), 'cache') or contains(lower(response), 'queue') then 0.25 else 0 end as q, conv_id % 10 as suite from w)
select suite, count(*) as n, round(avg(c), 6) as correctness, round(avg(q), 6) as quality, round(avg((c + q) / 2), 6) as overall from a group by suite""")
def evaluation_summary(spark, d):
    """Means by suite, ten of conversations."""
    t = answered_turns(spark, d)
    c, q = reasoning.correctness(F.col("response"), F.col("query")), reasoning.architecture_quality(F.col("response"), F.col("query"))
    e = t.select((F.col("conv_id") % 10).alias("suite"), c.alias("correctness"), q.alias("quality"))
    return reasoning.summary(e, "suite", ["correctness", "quality"]).select("suite", "n", *(r6(x).alias(x) for x in ("correctness", "quality", "overall")))


@query(f"""{DRAWN}, l as (select distinct user_id, '    user' || user_id || ' --> ' || service as line from e where event_id % 6 <> 0)
select user_id as id, 'graph TD' || chr(10) || string_agg(line, chr(10) order by line) as mermaid, '@startuml' || chr(10) || string_agg(trim(line), chr(10) order by line) || chr(10) || '@enduml' as plantuml from l group by user_id""")
def drawings_as_text(spark, d):
    found = drawings.relations(user_drawings(spark, d), "sequence")
    return extract.to_mermaid(found).join(extract.to_plantuml(found), "id")


@query("select event_id as id, epoch_us(ts) as us, case when event_type = 'error' then 'error' when event_type = 'view' then 'warn' else 'info' end as level, case when user_id % 4 = 0 then 'unknown' else 'svc' || (user_id % 4) end as service, 'events' as source from events")
def logs_normalised(spark, d):
    e = tables.read(spark, d, "events")
    raw = e.select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"), F.col("event_id").cast("string").alias("message"), F.when(F.col("event_type") == "error", " ERROR").when(F.col("event_type") == "view", "Warn").when(F.col("event_type") == "click", "").alias("level"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("svc"), (F.col("user_id") % 4).cast("string"))).alias("service"), F.lit("events").alias("source"))
    n = ingest.normalised_logs(raw)
    return n.select(F.col("message").cast("long").alias("id"), F.unix_micros("at").alias("us"), "level", "service", "source")


@query(f"""with {DOCS}, {EVENTS}, a as (select 'docs' as source, cast(id as varchar) as id, 0 as b, row_number() over (order by ({hits_sql('zebra over')}) desc, seq) as seq from docs where {hits_sql('zebra over')} > 0 qualify seq <= 4),
b as (select 'code' as source, cast(id as varchar) as id, 1 as b, row_number() over (order by ({hits_sql('click', 'message')}) desc, seq) as seq from ev where {hits_sql('click', 'message')} > 0 qualify row_number() over (order by ({hits_sql('click', 'message')}) desc, ev.seq) <= 12)
select source, id from (select * from a union all select * from b) order by b, seq limit 10""")
def code_fallback(spark, d):
    """Few documents are found, so code rows are appended up to the limit."""
    docs, code_rows = retrieve.docs_source(tables.docs(spark, d)), retrieve.events_source(tables.events(spark, d))
    return retrieve.with_fallback(docs("zebra over", 4), code_rows("click", 12), 10).select("source", "id")
