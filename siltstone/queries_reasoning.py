"""Queries of walks through the graph and of reasoning along it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import code, graph, knowledge, planner, reasoning
from siltstone.queries import CLASSIFIED, EDGES, any_sql, case_sql, named_sql, query, r6
from siltstone.queries_search import MATCHES_SQL, PATTERNS
from siltstone.sources import tables
from siltstone.streaming import caches, ingest

BOTH = f"{EDGES}, both_ways as (select src as a, dst as b, type from edges union all select dst, src, type from edges), near as (select a, b, row_number() over (partition by a order by b, type) as place from both_ways qualify place <= 3)"


@query(f"""with {BOTH}, ids as (select distinct a as id from both_ways),
m as (select id as start, id as node, [id] as way, []::bigint[] as place from ids
  union all select x.a, x.b, [x.a, x.b], [x.place] from near x where x.a <> x.b
  union all select x.a, y.b, [x.a, x.b, y.b], [x.place, y.place] from near x join near y on y.a = x.b where x.a <> x.b and y.b <> x.a and y.b <> x.b)
select start, array_to_string(list(node order by place)[1:3], '>') as nodes from m group by start""")
def graph_traversals(spark, d):
    """Walks from every node that has an edge, in both directions; nations lead to three of their many customers."""
    e = graph.oriented(tables.edges(spark, d), "both").select(F.col("a").alias("src"), F.col("b").alias("dst"), "type")
    out = graph.traversals(e.select(F.col("src").alias("id")), e)
    return out.select("start", F.array_join("nodes", ">").alias("nodes"))


def names_graph(spark, d):
    """Edges between names: customers to nations, nations to regions and to their customers."""
    get = lambda n: tables.read(spark, d, n)
    n, c = get("nation"), get("customer")
    to_nation = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"))
    to_region = n.join(get("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    back = to_nation.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return to_nation.unionByName(to_region).unionByName(back).withColumn("type", F.lit("IN"))


def order_questions(spark, d):
    """A question a customer that names customer and nation, with the customer's five dearest orders as facts."""
    get = lambda n: tables.read(spark, d, n)
    named = get("customer").join(get("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = named.select(F.col("c_custkey").alias("qid"), F.concat(F.lit("what did "), F.col("c_name"), F.lit(" of "), F.col("n_name"), F.lit(" order?")).alias("query"))
    content = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("for Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" "))), F.lit("order "), F.col("o_orderkey").cast("string"))
    facts = get("orders").select(F.col("o_custkey").alias("qid"), content.alias("content"), F.col("o_orderpriority").alias("source"), (F.col("o_totalprice") / 1e6).alias("score"), F.row_number().over(reasoning_window()).alias("rank")).where("rank <= 5")
    held = reasoning.gathered(facts)
    return asked.join(held, "qid", "left")


def reasoning_window():
    return Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("""with q as (select c_custkey as qid, c_name, n_name, list_sort([c_name, n_name]) as entities from customer join nation on c_nationkey = n_nationkey),
f as (select o_custkey as qid, case when o_orderkey % 3 = 0 then '' else 'for Customer#' || lpad(cast(o_custkey as varchar), 9, '0') || ' ' end || 'order ' || o_orderkey as content, o_orderpriority as source, o_totalprice / 1e6 as score,
  row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 5),
g as (select q.qid, f.*exclude (qid), bool_or(contains(lower(content), lower(c_name)) or contains(lower(content), lower(n_name))) over (partition by q.qid) as any_named, contains(lower(content), lower(c_name)) or contains(lower(content), lower(n_name)) as named from q join f on f.qid = q.qid),
h as (select qid, list(content order by rank) as c, list(source order by rank)[1:3] as s, avg(score) as score from g where named or not any_named group by qid),
e as (select c_name as a, n_name as b from customer join nation on c_nationkey = n_nationkey union all select n_name, r_name from nation join region on n_regionkey = r_regionkey union all select n_name, c_name from customer join nation on c_nationkey = n_nationkey),
near as (select a, b, row_number() over (partition by a order by b) as place from e qualify place <= 3),
m as (select q.qid, id as start, id as node, []::bigint[] as place from q, unnest(q.entities) t(id)
  union all select q.qid, x.a, x.b, [x.place] from q, near x where list_contains(q.entities, x.a)
  union all select q.qid, x.a, y.b, [x.place, y.place] from q, near x, near y where list_contains(q.entities, x.a) and y.a = x.b and list_contains(q.entities, y.a) and y.b <> x.a),
p as (select qid, start, list(node order by place)[1:3] as nodes from m group by qid, start),
w as (select qid, string_agg(array_to_string(nodes, '>'), '|' order by start) as paths, sum(len(nodes)) / count(*) as length, count(*) as n from p group by qid)
select q.qid, array_to_string(q.entities, ',') as entities, w.paths, n + 1 as n_steps,
  case when h.c is null then 'No relevant information found.' else array_to_string(c[1:2], ' | ') end as answer, round(least(coalesce(h.score, 0) + w.length * 0.2, 1.0), 6) as confidence, coalesce(array_to_string(s, ','), '') as sources
from q join w using (qid) left join h using (qid)""")
def entity_reasoning(spark, d):
    out = reasoning.entity_aware(order_questions(spark, d), names_graph(spark, d))
    paths = F.array_join(F.transform("paths", lambda p: F.array_join(p["nodes"], ">")), "|")
    return out.select("qid", F.array_join("entities", ",").alias("entities"), paths.alias("paths"), F.size("steps").cast("long").alias("n_steps"), "answer", r6("confidence").alias("confidence"), F.array_join("sources", ",").alias("sources"))


# Code made from suppliers: a file a nation, a class a supplier, a method for each of its digits


def supplier_code(spark, d):
    """(path, content): Python files that grow with the suppliers."""
    s = tables.read(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    method = lambda i: F.concat(F.lit("    def step_"), i.cast("string"), F.lit("(self, rows):\n        return load_"), i.cast("string"), F.lit("(self.rows('class Fake:'))\n"))
    methods = F.array_join(F.transform(F.sequence(F.lit(1), F.col("s_suppkey") % 3 + 1), method), "")
    text = F.concat(F.lit("class Supplier"), k, F.lit("(Base, shop.Seller):\n    \"\"\"def not_this(): pass\"\"\"\n"), methods, F.lit("\n"))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", text.alias("t")))), lambda x: x["t"]), "")
    return s.groupBy("s_nationkey").agg(held.alias("t")).select(F.concat(F.lit("src/nation"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("import shop\n"), F.col("t")).alias("content"))


CODE_SQL = """s as (select s_nationkey, s_suppkey as k, s_suppkey % 3 + 1 as n, 1 + coalesce(sum(3 + 2 * (s_suppkey % 3 + 1)) over (partition by s_nationkey order by s_suppkey rows between unbounded preceding and 1 preceding), 0) as before from supplier),
c as (select 'src/nation' || s_nationkey || '.py' as path, * from s),
found as (
  select path, 'class' as kind, 'Supplier' || k as qualified, null as parent, before + 1 as start_line, before + 2 + 2 * n as end_line, 'Base,shop.Seller' as bases, '' as calls from c
  union all select path, 'method', 'Supplier' || k || '.step_' || i, 'Supplier' || k, before + 1 + 2 * i, before + 2 + 2 * i, '', 'load_' || i || ',self.rows' from c, range(1, 4) t(i) where i <= n
  union all select distinct path, 'import', 'shop', null, null, null, '', '' from c)"""


@query(f"with {CODE_SQL} select path, kind, qualified, parent, coalesce(start_line, 0)::bigint as start_line, coalesce(end_line, 0)::bigint as end_line, bases, calls from found")
def code_structure(spark, d):
    out = code.structure(supplier_code(spark, d))
    return out.select("path", "kind", "qualified", "parent", F.coalesce("start_line", F.lit(0)).cast("long").alias("start_line"), F.coalesce("end_line", F.lit(0)).cast("long").alias("end_line"), F.array_join("bases", ",").alias("bases"), F.array_join("calls", ",").alias("calls"))


@query(f"""with {CODE_SQL} select path || '::' || coalesce(parent, '') as a, path || '::' || qualified as dst, 'CONTAINS' as type from found where kind <> 'import' and parent is not null
union all select 'file:' || path, path || '::' || qualified, 'CONTAINS' from found where kind <> 'import' and parent is null
union all select 'file:' || path, 'module:shop', 'IMPORTS' from found where kind = 'import'""".replace("as a, path", "as src, path"))
def code_graph_edges(spark, d):
    return code.code_graph(code.structure(supplier_code(spark, d)))[1]


@query(f"""with {CODE_SQL} select 'file:' || path as src, qualified as dst, 'CONTAINS' as type from found where kind <> 'import'
union all select qualified, 'load_' || regexp_extract(qualified, '_(\\d)$', 1), 'CALLS' from found where kind = 'method' union all select qualified, 'self.rows', 'CALLS' from found where kind = 'method'
union all select qualified, 'shop', 'IMPORTS' from found where kind <> 'import' union all select qualified, unnest(['Base', 'shop.Seller']), 'INHERITS' from found where kind = 'class'""")
def code_entity_edges(spark, d):
    return code.entity_edges(code.structure(supplier_code(spark, d)))


# Caches and telemetry


@query()
def cache_replayed(spark, d):
    """Every event looks up its value of k in the cache of its user; entries live two days."""
    e = tables.events(spark, d).select(F.col("user_id").alias("cache"), "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.lit("look").alias("op"), F.col("k").cast("string").alias("key"), F.col("metric_name").alias("value"))
    return caches.replay(e, 20, 172_800.0).select("cache", "id", "hit", "value", "size")


@query()
def cache_hit_rates(spark, d):
    e = tables.events(spark, d).select(F.col("user_id").alias("cache"), "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.lit("look").alias("op"), F.col("k").cast("string").alias("key"), F.col("metric_name").alias("value"))
    return caches.stats(caches.replay(e, 20, 172_800.0), 20)


@query("""with e as (select event_id as id, ts, 'svc' || cast(user_id % 10 as varchar) as service, event_type, value from events)
select a.service, a.id as log_id, b.id as metric_id, b.event_type as metric, round(b.value, 6) as value from e a join e b on a.service = b.service and b.ts between a.ts - interval 30 seconds and a.ts + interval 30 seconds
where a.event_type = 'error' and b.event_type in ('purchase', 'click')""")
def telemetry_joined(spark, d):
    e = tables.events(spark, d)
    out = ingest.bucketed_pairs(e.where("metric_name = 'error'"), e.where("metric_name in ('purchase', 'click')"), 30)
    return out.select("service", "log_id", "metric_id", "metric", r6("value").alias("value"))


# Plans, verdicts, citations and checks of answers


@query(f"""with {CLASSIFIED}, p as (select qid, trim({case_sql(planner.INTENT_WORDS | {"design ": planner.SKETCH_WORDS}, "case l[1] when 'causal' then 'troubleshoot' when 'complex' then 'design' else 'explain' end")}) as intent, {named_sql(planner.SOURCE_WORDS)} as s, {named_sql(planner.TOOL_WORDS)} as t from k),
f as (select qid, t, case intent when 'design' then ['analyze:analyze_ir:ir:', 'retrieve:search:docs:', 'retrieve:search:code:', 'reason:generate_architecture::'] when 'troubleshoot' then ['retrieve:search:tickets:', 'retrieve:search:telemetry:', 'analyze:analyze_logs::', 'reason:diagnose::']
  else list_transform(case when len(s) > 0 then s else ['{"', '".join(planner.ALL_SOURCES)}'] end, lambda x: 'retrieve:search:' || x || ':10') end as a from p)
select qid, array_to_string(list_concat(a, case when len(t) > 0 then ['tool:execute_tools::' || array_to_string(t, '+')] else [] end, ['reason:generate_answer::']), '|') as steps from f""")
def plan_steps(spark, d):
    p = planner.steps(planner.plans(tables.queries(spark, d)))
    text = lambda s: F.concat_ws(":", s["step_type"], s["action"], F.coalesce(s["source"], F.lit("")), F.coalesce(s["limit"].cast("string"), F.array_join(s["tools"], "+")))
    return p.select("qid", F.array_join(F.transform("steps", text), "|").alias("steps"))


@query(f"""with {CLASSIFIED}, p as (select qid, query, {named_sql(planner.SOURCE_WORDS)} as s from k), z as (select qid, query, case when len(s) > 0 then s else ['{"', '".join(planner.ALL_SOURCES)}'] end as s from p),
x as (select unnest(['docs', 'code', 'tickets', 'telemetry']) as source, unnest(['SAP BTP ', '', '', '']) as before, unnest(['', ' implementation', ' known issues', ' logs metrics']) as after)
select qid, source, k::bigint as k, sha256(case k when 0 then query else before || query || after end) as asked from z, x, range(2) r(k) where list_contains(s, source)""")
def source_queries(spark, d):
    q = planner.source_queries(planner.plans(tables.queries(spark, d)))
    return q.select("qid", "source", F.col("k").cast("long").alias("k"), F.sha2("asked", 256).alias("asked"))


#: Rules of platforms for questions made from orders, a condition a row.
RULES = [("no-rest", "sap", "error", "technologies", "contains", "rest"), ("no-rest", "sap", "error", "intent", "eq", "design"), ("named", "sap", "warning", "technology", "eq", "true"), ("slow", "tanzu", "error", "intent", "eq", "optimize"), ("any", "tanzu", "warning", "platform", "eq", "tanzu")]


def order_wishes(spark, d):
    """A question an order, whose words tell platform, technology and intent by its keys."""
    o = tables.read(spark, d, "orders")
    pick = lambda c, words: F.element_at(F.array(*map(F.lit, words)), (c % len(words) + 1).cast("int"))
    text = F.concat_ws(" ", pick(F.col("o_orderkey"), ["design", "optimize", "tell", "explain", "move"]), pick(F.col("o_custkey"), ["rest", "graphql", "it", "database jwt"]), F.lit("on"), pick(F.col("o_orderkey") + F.col("o_custkey"), ["kyma", "knative", "dataverse", "paper"]))
    return o.select(F.col("o_orderkey").alias("qid"), text.alias("query"))


@query(f"""with o as (select o_orderkey as qid, ['design', 'optimize', 'tell', 'explain', 'move'][o_orderkey % 5 + 1] || ' ' || ['rest', 'graphql', 'it', 'database jwt'][o_custkey % 4 + 1] || ' on ' || ['kyma', 'knative', 'dataverse', 'paper'][(o_orderkey + o_custkey) % 4 + 1] as query from orders),
k as (select qid, query, {case_sql(knowledge.INTENT_WORDS, "'analyze'")} as intent, {named_sql(knowledge.PLATFORM_WORDS)} as p, {named_sql({t: [t] for t in knowledge.TECHNOLOGIES})} as t from o),
v as (select *, list_filter([case when p[1] = 'tanzu' then 'any' end, case when p[1] = 'sap' and len(t) > 0 then 'named' end, case when p[1] = 'sap' and contains(array_to_string(t, ','), 'rest') and intent = 'design' then 'no-rest' end, case when p[1] = 'tanzu' and intent = 'optimize' then 'slow' end], lambda x: x is not null) as found from k),
e as (select *, len(list_filter(found, lambda x: x in ('no-rest', 'slow'))) as errors, {MATCHES_SQL} as m from v)
select qid, array_to_string(found, ',') as violations, errors = 0 as can_proceed, 'Intent: ' || intent || case when len(m) > 0 then ' | Recommended: ' || m[1].n || ' (' || (-10 * m[1].r) || '%)' else '' end || case when errors > 0 then ' | Blocking: ' || errors || ' issues' else '' end as reasoning from e""")
def resolver_verdicts(spark, d):
    rules = spark.createDataFrame(RULES, "rule string, platform string, severity string, feature string, operator string, expected string")
    v = knowledge.verdicts(knowledge.match_patterns(knowledge.resolve(order_wishes(spark, d)), PATTERNS), rules)
    return v.select("qid", F.array_join("violations", ",").alias("violations"), "can_proceed", "reasoning")


@query("""with s as (select unnest(['parenthetical', 'footnote', 'verbatim', 'highlight', 'structured']) as style), o as (select o_custkey as id, count(*) as n from orders group by 1)
select id, style, 'so it is' || case style when 'parenthetical' then ' (see [' || array_to_string(list_transform(range(1, n + 1), lambda i: i::varchar), ', ') || '])' when 'footnote' then ' ' || array_to_string(list_transform(range(1, n + 1), lambda i: '[' || i || ']'), ' ') else '' end as cited from o, s""")
def citation_styles(spark, d):
    o = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    cited = F.array(*(F.struct(F.lit(s).alias("style"), reasoning.cite(F.lit("so it is"), F.col("n"), s).alias("cited")) for s in ("parenthetical", "footnote", "verbatim", "highlight", "structured")))
    return o.select("id", F.explode(cited).alias("c")).select("id", "c.style", "c.cited")


TURNS = "turns as (select conv_id, turn, text as query, lead(text) over (partition by conv_id order by turn) as response, role from conversations), pairs as (select * from turns where role = 'user' and response is not null)"


def answered_turns(spark, d):
    t = tables.read(spark, d, "conversations").withColumn("response", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.where("role = 'user' and response is not null").select("conv_id", "turn", F.col("text").alias("query"), "response")


@query(f"""with {TURNS}, w as (select *, list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '') as words, list_filter(list_distinct(string_split_regex(lower(query), '\\s+')), lambda x: length(x) > 6) as aspects from pairs)
select conv_id, turn, round(case when query = '' then 0.5 when contains(lower(response), lower(query)) then 1.0 else len(list_filter(words, lambda x: contains(lower(response), x))) / greatest(len(words), 1)::double end, 6) as correctness,
  round(len(list_filter(aspects, lambda x: contains(lower(response), x))) / greatest(len(aspects), 1)::double, 6) as relevance,
  0.5 + case when contains(lower(query), 'architecture') and (contains(lower(response), 'component') or contains(lower(response), 'service') or contains(lower(response), 'api')) then 0.25 else 0 end + case when contains(lower(response), 'database') or contains(lower(response), 'cache') or contains(lower(response), 'queue') then 0.25 else 0 end as quality from w""")
def answer_quality(spark, d):
    """Correctness, relevance and quality of the answer to every user turn, the longer words of the turn being what is expected."""
    t = answered_turns(spark, d)
    aspects = F.filter(F.array_distinct(F.split(F.lower("query"), r"\s+")), lambda x: F.length(x) > 6)
    q, r = F.col("query"), F.col("response")
    return t.select("conv_id", "turn", r6(reasoning.correctness(r, q)).alias("correctness"), r6(reasoning.relevance(r, aspects)).alias("relevance"), reasoning.architecture_quality(r, q).cast("double").alias("quality"))


TOPIC_LIST = "['" + "', '".join(reasoning.TOPICS) + "']"


@query(f"""with {TURNS}, t as (select *, list_filter(list_distinct(string_split_regex(lower(query), '\\s+')), lambda w: length(w) >= 4) as terms,
  list_distinct(list_filter(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) > 4), lambda w: list_contains({TOPIC_LIST}, w))) as asked,
  list_filter(string_split_regex(lower(response), '\\s+'), lambda w: length(w) > 4) as told from pairs),
c as (select *, len(list_filter(terms, lambda w: not contains(lower(response), w))) as accuracy,
  case when ({any_sql(reasoning.QUESTIONS)}) and length(response) < 50 then 1 else 0 end + case when contains(query, '?') and not regexp_matches(response, '[?.!]$') then 1 else 0 end
  + case when len(list_filter(asked, lambda w: not list_contains(told, w))) > 0 and len(list_filter(asked, lambda w: not list_contains(told, w))) > floor(len(asked) / 2) then 1 else 0 end as completeness,
  {' + '.join(f"case when regexp_matches(response, '(?i){p}') then 1 else 0 end" for p in reasoning.DESTRUCTIVE)} as safety from t),
s as (select *, ((accuracy = 0)::int + (completeness = 0)::int + (safety = 0)::int + 1) / 4.0::double as score from c)
select conv_id, turn, accuracy::bigint as accuracy_issues, completeness::bigint as completeness_issues, safety::bigint as safety_issues, safety = 0 as valid, score, (score + case when turn % 2 = 0 then 1.0 else 0.5 end) / 2 as confidence from s""")
def validation_outputs(spark, d):
    """Every output of the validation of the answer to a user turn; odd turns have one relevant source of two."""
    relevant = F.when(F.col("turn") % 2 == 0, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    v = reasoning.validate(answered_turns(spark, d).withColumns({"contexts": F.array("response"), "relevant": relevant}))
    return v.select("conv_id", "turn", "accuracy_issues", "completeness_issues", "safety_issues", "valid", F.col("score").cast("double").alias("score"), F.col("confidence").cast("double").alias("confidence"))
