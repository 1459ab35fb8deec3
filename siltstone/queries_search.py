"""More queries: refinement of questions, code graphs, sinks, tooling collections, logs and knowledge."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from siltstone.functions import text
from siltstone.operators import extract, graph, knowledge, reasoning, retrieval, rules, telemetry, tooling
from siltstone.queries import ASK, CALLS, EDGES, EVENTS, FACTS_SQL, NODES, case_sql, extracted_sql, facts, named_sql, query, r6
from siltstone.sources import tables
from siltstone.streaming import ingest

WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
READ = tables.read


# Questions and their refinement


@query(rf"""with {ASK}, w as (select qid, query, {WORDS.format('query')} as w from ask)
select qid, case when len(w) > 5 then array_to_string(w[len(w) // 2 + 1:], ' ') end as second_half, case when len(w) > 0 then array_to_string(w[1:10], ' ') end as head,
  substr(trim(query || ' ' || substr(query, 1, 100)), 1, 500) as refined from w""")
def query_refinement(spark, d):
    q, own = F.col("query"), F.array("query")
    return tables.queries(spark, d).select("qid", text.decompose_query(q).alias("second_half"), text.focus_query(own).alias("head"), text.refined_query(q, own).alias("refined"))


@query(rf"""with w as (select doc_id as id, {WORDS.format('text')} as w from documents), u as (select id, unnest(w) as x, generate_subscripts(w, 1) as o from w),
n as (select id, x, row_number() over (partition by id order by min(o)) as r from u where regexp_matches(x, '^\p{{Lu}}') and length(x) > 2 group by id, x),
k as (select id, x, row_number() over (partition by id order by min(o)) as r from u where length(x) > 5 group by id, x),
a as (select id, string_agg(x, ' ' order by r) as t from n where r <= 10 group by id), b as (select id, string_agg(x, ' ' order by r) as t from k where r <= 10 group by id)
select w.id, coalesce(a.t, '') as names, coalesce(b.t, '') as keywords from w left join a on a.id = w.id left join b on b.id = w.id""")
def refine_terms(spark, d):
    names, keys = text.refine_terms(F.coalesce("content", F.lit("")))
    return tables.docs(spark, d).select("id", F.array_join(names, " ").alias("names"), F.array_join(keys, " ").alias("keywords"))


@query(rf"""with {ASK}, w as (select *, {WORDS.format('query')} as w from ask)
select qid, coalesce(nullif(regexp_extract(query, '(?i)(?:find|get|show)\s+(?:all\s+)?(?:callers?|callees?)\s+of\s+(\w+)', 1), ''), nullif(regexp_extract(query, '(?i)(?:who|what)\s+(?:calls?|uses?|imports?)\s+(\w+)', 1), ''),
  nullif(regexp_extract(query, '(?i)(\w+)\s+(?:function|method|class|module)', 1), ''), nullif(regexp_extract(query, '(?i)entities?\s+(?:for|related to)\s+(\w+)', 1), ''), case when len(w) between 1 and 3 then w[-1] end) as entity from w""")
def query_entity(spark, d):
    return tables.queries(spark, d).select("qid", text.query_entity(F.col("query")).alias("entity"))


@query("select doc_id as id, regexp_matches(text, '[Ѐ-ӿ]') as cyrillic, regexp_matches(text, '[A-Za-z]') as latin, case lang when 'ru' then 'Russian' when 'en' then 'English' else 'Unknown' end as language from documents")
def script_flags(spark, d):
    return tables.docs(spark, d).select("id", text.is_cyrillic(F.col("content")).alias("cyrillic"), text.is_latin(F.col("content")).alias("latin"), text.language_name(F.col("lang")).alias("language"))


@query("with p as (select *, n_chars % 100 as p from documents) select doc_id as id, replace(substr(text, greatest(0, p - 50) + 1, p + 50 - greatest(0, p - 50)), chr(10), ' ') as context from p")
def context_windows(spark, d):
    at = (F.col("n_chars") % 100).cast("int")
    return READ(spark, d, "documents").select(F.col("doc_id").alias("id"), text.context_window(F.col("text"), at).alias("context"))


@query("select event_id as id, case event_type when 'view' then 0.25 when 'click' then 0.5 when 'purchase' then 1.0 else 0.0 end::double as progress from events")
def job_progress(spark, d):
    status = F.when(F.col("event_type") == "view", "chunking").when(F.col("event_type") == "click", "embedding").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return READ(spark, d, "events").select(F.col("event_id").alias("id"), text.progress(status).alias("progress"))


@query("select event_id as id, json_extract_string(props, '$.k') as k from events")
def nested_values(spark, d):
    return READ(spark, d, "events").select(F.col("event_id").alias("id"), rules.nested(F.col("props"), "k").alias("k"))


@query(f"""with {FACTS_SQL}, g as (select qid, list(content order by rank) as c from k group by 1), h as (select qid, c, list_filter(c, lambda x: contains(lower(x), 'wh')) as a from g)
select qid, sha256(array_to_string(case when len(a) > 0 then a else c end, '|')) as about from h""")
def entity_facts(spark, d):
    about = reasoning.facts_about(F.col("facts"), F.array(F.lit("Wh")))
    return facts(spark, d).select("qid", F.sha2(F.array_join(F.transform(about, lambda f: f["content"]), "|"), 256).alias("about"))


# Graphs of entities and code


@query(f"with {EDGES} select src, dst from edges where type = 'LOCATED_IN' and dst = 'nation:3'")
def typed_edges(spark, d):
    return graph.match_edges(tables.edges(spark, d), ["LOCATED_IN"], dst="nation:3").select("src", "dst")


@query(f"with {NODES}, {EDGES}, n as (select id from nodes where type <> 'customer') select src, dst, type from edges where src in (select id from n) and dst in (select id from n)")
def known_edges(spark, d):
    return graph.known_ends(tables.edges(spark, d), tables.nodes(spark, d).where("type <> 'customer'")).select("src", "dst", "type")


@query(f"""with {extracted_sql()}, p as (select a.id, a.e.name as a, b.e.name as b, row_number() over (partition by a.id order by a.e.ord, b.e.ord) as r from ent a join ent b on a.id = b.id and b.e.ord between a.e.ord + 1 and a.e.ord + 9)
select id, a, b from p where r <= 50""")
def entity_pairs(spark, d):
    return extract.pairs_in_window(extract.entities(tables.docs(spark, d)))


@query("""select 'nation:' || n_nationkey as id, case when n_nationkey % 2 = 0 then 'country' else 'nation' end as type, case when n_nationkey % 2 = 0 then upper(n_name) else n_name end as name, case when n_nationkey % 2 = 0 then cast(n_regionkey as varchar) end as region from nation
union all select 'new:' || r_regionkey, 'country', r_name, cast(r_regionkey as varchar) from region""")
def merged_nodes(spark, d):
    n, r = READ(spark, d, "nation"), READ(spark, d, "region")
    made = lambda rows, kind, key, name, region: rows.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("id"), F.lit("country").alias("type"), F.create_map(F.lit("name"), name, F.lit("region"), F.col(region).cast("string")).alias("properties"))
    current = n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("type"), F.create_map(F.lit("name"), "n_name").alias("properties"))
    new = made(n.where("n_nationkey % 2 = 0"), "nation:", "n_nationkey", F.upper("n_name"), "n_regionkey").unionByName(made(r, "new:", "r_regionkey", F.col("r_name"), "r_regionkey"))
    return graph.merge_nodes(current, new).select("id", "type", F.col("properties")["name"].alias("name"), F.col("properties")["region"].alias("region"))


@query(f"with {NODES}, {EDGES}, n as (select id from nodes where type <> 'customer') select distinct src, dst, type from edges where src in (select id from n) and dst in (select id from n)")
def merged_edges(spark, d):
    e = tables.edges(spark, d)
    return graph.merge_edges(e.where("type = 'CONTAINS'"), e, tables.nodes(spark, d).where("type <> 'customer'")).select("src", "dst", "type")


def classes(spark, d) -> DataFrame:
    """Part k inherits part k // 2."""
    p = READ(spark, d, "part").where("p_partkey >= 2")
    name = lambda c: F.concat(F.lit("cls"), F.expr(c).cast("string"))
    return p.select(name("p_partkey").alias("src"), name("p_partkey div 2").alias("dst"), F.lit("INHERITS").alias("type"))


@query("""with recursive e as (select p_partkey as k, p_partkey // 2 as p from part where p_partkey >= 2), u as (select p as n, 1 as x from e where k = 5 union all select e.p, x + 1 from u join e on e.k = u.n where x < 10),
w as (select k as n, 1 as x from e where p = 5 union all select e.k, x + 1 from w join e on e.p = w.n where x < 10)
select 'cls' || n as node, cast(-x as bigint) as distance from u union all select 'cls' || n, cast(x as bigint) from w""")
def class_hierarchy(spark, d):
    return graph.hierarchy(classes(spark, d), "cls5").select("node", F.col("distance").cast("long").alias("distance"))


@query("select 'cls' || p_partkey as subclass, 'cls' || p_partkey // 2 as parent from part where p_partkey >= 2 and p_partkey % 2 = 1 and (p_partkey // 2) % 2 = 1 and p_partkey // 2 in (select p_partkey from part)")
def overridden_methods(spark, d):
    m = READ(spark, d, "part").select(F.concat(F.lit("cls"), F.col("p_partkey").cast("string")).alias("class"), F.concat(F.lit("m"), (F.col("p_partkey") % 2).cast("string")).alias("name"))
    return graph.overrides(m, classes(spark, d), "m1")


@query(f"with {CALLS} select distinct dst as name, cast(1 as bigint) as distance from calls where src = 'fn10'")
def code_query(spark, d):
    return graph.code_query(tables.code_edges(spark, d), "find_callees", "fn10").select("name", F.col("distance").cast("long").alias("distance"))


@query("select p_partkey as id, cast(1 + 2 * p_size as bigint) as complexity from part order by 2 desc, 1 limit 20")
def complex_functions(spark, d):
    code = READ(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("repeat('if x and y: ', p_size)").alias("code"))
    return code.select("id", extract.complexity(F.col("code")).alias("complexity")).orderBy(F.desc("complexity"), "id").limit(20)


@query("select n_nationkey as id, cast(contains('nation_1 in region_0', lower(n_name)) as int) + 0.5::double * cast(contains('nation_1 in region_0', 'region_' || n_regionkey) as int) as score from nation order by 2 desc, 1 limit 10")
def diagram_ranking(spark, d):
    score = retrieval.diagram_score(F.lit("Nation_1 in Region_0"), F.array("n_name"), F.array(F.concat(F.lit("Region_"), F.col("n_regionkey").cast("string"))))
    return READ(spark, d, "nation").select(F.col("n_nationkey").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(10)


# Groups, versions and sinks


@query("select source, doc_id as id from documents qualify row_number() over (partition by source order by doc_id) <= 3")
def first_per_source(spark, d):
    return retrieval.first_per_group(tables.docs(spark, d), ["source"], 3, "seq").select("source", "id")


@query("select o_custkey as customer, o_orderkey as content from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 2")
def version_rollback(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    versions = READ(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("content"), F.row_number().over(w).alias("version"))
    return telemetry.version_at(versions, 2).select("customer", "content")


@query("select lang, count(*) as n from documents where lang is distinct from 'en' group by 1")
def delete_by_source(spark, d):
    return ingest.delete_source(READ(spark, d, "documents"), "en", "lang").groupBy("lang").agg(F.count("*").alias("n"))


@query("with x as (select user_id, event_type from events group by 1, 2), g as (select user_id, count(*) as a, count(*) filter (where event_type in ('click', 'view', 'refund')) as h from x group by 1) select user_id as key, round(h / a, 6) as precision, round(h / 3, 6) as recall, round(2.0 * h / (a + 3), 6) as f1 from g")
def element_f1(spark, d):
    e = READ(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"))
    want = e.select("key").distinct().select("key", F.explode(F.array(*map(F.lit, ("click", "view", "refund")))).alias("kind"))
    return tooling.element_f1(e, want).select("key", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


# Logs, tooling collections and plans over them


@query(f"with {EVENTS} select id, severity as level, service, message from ev where service = 'svc3' and ts >= timestamp '2024-01-02' and ts < timestamp '2024-01-20' order by ts desc, id limit 100")
def log_range(spark, d):
    lines = tables.events(spark, d).withColumn("labels", F.create_map(F.lit("service"), "service", F.lit("level"), F.when(F.col("severity") != "info", F.col("severity"))))
    return tooling.log_range(lines, {"service": "svc3"}, datetime(2024, 1, 2), datetime(2024, 1, 20)).drop("ts")


#: Values that rows of the test collections take in turn, by filter.
COLLECTION_VALUES = {"language": ["python", "go", "java"], "kind": ["Deployment", "Service", "Gateway"], "chart_name": ["web", "db", "queue"], "instruction": ["FROM", "RUN", "COPY"], "hosts": ["a.example.com", "b.example.com", "c.example.com"]}
#: One filter for each collection's scan.
SCANS = {"code": ("language", 1), "kubernetes": ("kind", 0), "helm": ("chart_name", 2), "dockerfile": ("instruction", 1), "graphql": ("kind", 1), "istio": ("hosts", 0)}
COSINE = "list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0))"


def collection(spark, d) -> DataFrame:
    """Vectors as rows of a tooling collection, with every filter column."""
    rows = READ(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("row "), F.col("vec_id").cast("string")).alias("content"), "embedding")
    return rows.withColumns({n: F.element_at(F.array(*map(F.lit, v)), (F.col("id") % 3 + 1).cast("int")) for n, v in COLLECTION_VALUES.items()})


def first_vector(spark, d) -> list[float]:
    return READ(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


@query(" union all ".join(f"(select '{name}' as collection, vec_id as id, round({COSINE}, 6) as score from embeddings where vec_id % 3 = {k} order by {COSINE} desc, vec_id limit 10)" for name, (_, k) in SCANS.items()))
def tooling_scans(spark, d):
    rows, q, out = collection(spark, d), first_vector(spark, d), None
    for name, (column, k) in SCANS.items():
        part = tooling.scan(rows, name, q, 10, **{column: COLLECTION_VALUES[column][k]}).select(F.lit(name).alias("collection"), "id", r6("score").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with s as (select unnest(['kubernetes', 'helm']) as source), v as (select source, cast(vec_id as varchar) as id, row_number() over (partition by source order by {COSINE} desc, vec_id) as rn from s, embeddings where vec_id % 2 = case source when 'helm' then 1 else 0 end qualify rn <= 10)
select source, id, round(1.0 / (60 + rn), 6) as score from v order by 1.0 / (60 + rn) desc, source, id limit 10""")
def tooling_search(spark, d):
    rows = collection(spark, d)
    found = tooling.search({"kubernetes": rows.where("id % 2 = 0"), "helm": rows.where("id % 2 = 1")}, ["kubernetes", "helm"], first_vector(spark, d))
    return found.select("source", "id", r6("fused_score").alias("score"))


@query(f"""with {NODES}, b as (select case type when 'region' then 0 when 'nation' then 1 when 'supplier' then 2 else 3 end as branch, id from nodes), n as (select branch, count(*) as n from b group by 1), s as (select branch, coalesce(sum(n) over (order by branch rows between unbounded preceding and 1 preceding), 0) as before from n)
select branch, id from b where branch in (select branch from s where before < 10)""")
def branch_cascade(spark, d):
    branch = F.when(F.col("type") == "region", 0).when(F.col("type") == "nation", 1).when(F.col("type") == "supplier", 2).otherwise(3)
    return tooling.until_enough(tables.nodes(spark, d).select(branch.alias("branch"), "id"), 10).select("branch", "id")


#: Endings of the test paths and the chunkers that belong to them.
ROUTES = [("main.py", "code"), ("README.md", "semantic"), ("notes.txt", "sentence"), ("deploy.yaml", "kubernetes"), ("chart.tpl", "helm"), ("schema.gql", "graphql"), ("Dockerfile", "dockerfile"), ("my-VirtualService", "istio"), ("istio/gateway.conf", "istio"), ("gateway.conf", "semantic")]


@query(f"with r as (select {[n for n, _ in ROUTES]} as n, {[c for _, c in ROUTES]} as c) select p_partkey as id, c[p_partkey % {len(ROUTES)} + 1] as chunker from part, r")
def chunker_routes(spark, d):
    path = F.concat(F.lit("src/"), F.element_at(F.array(*(F.lit(n) for n, _ in ROUTES)), (F.col("p_partkey") % len(ROUTES) + 1).cast("int")))
    return READ(spark, d, "part").select(F.col("p_partkey").alias("id"), tooling.chunker_of(path).alias("chunker"))


# Curated knowledge

PATTERNS = {"gateway": ["api", "rest"], "login": ["auth", "oauth", "jwt"], "store": ["database"], "front": ["graphql", "api"], "monolith": [], "layers": ["rest"]}
MATCHES_SQL = "list_sort(list_filter([" + ", ".join(f"{{'r': -least(10, 3 * len(p) + 2 * len(list_filter(t, lambda x: list_contains(cast({v} as varchar[]), x)))), 'k': {k}, 'n': '{n}'}}" for k, (n, v) in enumerate(PATTERNS.items())) + "], lambda m: m.r < 0))[1:5]"


@query(f"""with {ASK}, k as (select qid, {case_sql(knowledge.INTENT_WORDS, "'analyze'")} as intent, {named_sql(knowledge.PLATFORM_WORDS)} as p, {named_sql({t: [t] for t in knowledge.TECHNOLOGIES})} as t from ask)
select qid, intent, p[1] as platform, array_to_string(t, ',') as technologies, array_to_string(list_transform({MATCHES_SQL}, lambda m: m.n || ':' || -m.r), ',') as matches from k""")
def resolved_queries(spark, d):
    r = knowledge.match_patterns(knowledge.resolve(tables.queries(spark, d)), PATTERNS)
    shown = F.transform("matches", lambda m: F.concat(m["pattern"], F.lit(":"), F.round(m["score"] * 10).cast("int").cast("string")))
    return r.select("qid", "intent", "platform", F.array_join("technologies", ",").alias("technologies"), F.array_join(shown, ",").alias("matches"))


@query("""with k as (select 0 as branch, 'platform' as type, 'aws' as id, 'aws' as name, 0 as part, 0 as seq union all select 0, 'service', 's' || s_suppkey, s_name, 1, s_suppkey from supplier where s_suppkey % 6 = 0
union all select 1, 'use_case', 'u' || n_nationkey, n_name, 0, n_nationkey from nation union all select 2, 'adr', 'a' || r_regionkey, r_name, 0, r_regionkey from region union all select 3, 'reference_architecture', 'p' || p_partkey, p_name, 0, p_partkey from part)
select branch, type, id, name from k order by branch, part, seq limit 40""")
def knowledge_scan(spark, d):
    names = F.array(*map(F.lit, knowledge.PLATFORMS))
    s = READ(spark, d, "supplier").select(F.lit("service").alias("type"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.element_at(names, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("platform"), F.col("s_suppkey").cast("long").alias("seq"))
    p = spark.createDataFrame([("platform", n, n, n, 0) for n in knowledge.PLATFORMS], "type string, id string, name string, platform string, seq long")
    of = lambda t, c, mark, name: READ(spark, d, t).select(F.concat(F.lit(mark), F.col(c).cast("string")).alias("id"), F.col(name).alias("name"), F.col(c).cast("long").alias("seq"))
    kinds = {"use_case": of("nation", "n_nationkey", "u", "n_name"), "adr": of("region", "r_regionkey", "a", "r_name"), "reference_architecture": of("part", "p_partkey", "p", "p_name")}
    return knowledge.scan("Serverless lambda use case decision", p.unionByName(s), kinds, 40)


@query("select p_partkey as id from part where p_partkey % 3 in (0, 2) and p_type = 'ECONOMY'")
def repository_lookup(spark, d):
    given = F.array(F.array(F.lit("aws"), F.lit("azure")), F.array(F.lit("sap")), F.array(F.lit("gcp"), F.lit("aws")))
    rows = READ(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("status"), F.element_at(given, (F.col("p_partkey") % 3 + 1).cast("int")).alias("platforms"))
    return knowledge.lookup(rows, "aws", status="ECONOMY").select("id")
