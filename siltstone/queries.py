"""Queries over the test tables, one per operator, and the same in DuckDB's SQL.

Every query gives flat columns, with floats rounded to six digits, and a total order wherever
it keeps a limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siltstone.functions import text
from siltstone.operators import chunk, classify, extract, fusion, graph, layout, linking, planner, reasoning, retrieval, rules, telemetry
from siltstone.plans import retrieve
from siltstone.sources import tables
from siltstone.streaming import ingest, limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYWORDS = "error that the over"
#: Views that SQL queries share.
DOCS = "docs as (select doc_id as id, text as content, source, doc_id as seq from documents)"
EVENTS = "ev as (select event_id as id, ts, 'svc' || cast(user_id % 10 as varchar) as service, case event_type when 'error' then 'critical' when 'purchase' then 'warning' else 'info' end as severity, event_type || ' ' || props as message, event_type as metric_name, user_id, value, event_id as seq from events)"
NODES = """nodes as (
  select 'region:' || r_regionkey as id, 'region' as type, r_name as name from region
  union all select 'nation:' || n_nationkey, 'nation', n_name from nation
  union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier
  union all select 'customer:' || c_custkey, 'customer', c_name from customer)"""
EDGES = """edges as (
  select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst, 'CONTAINS' as type from nation
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN' from supplier
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN' from customer)"""
CALLS = """calls as (
  select 'fn' || k as src, 'fn' || t as dst from (select p_partkey as k, unnest([p_partkey * 2, p_partkey * 2 + 1]) as t from part where p_partkey % 7 <> 0)
  where t in (select p_partkey from part))"""
ASK = """ask as (
  select 'c' || conv_id || '-' || turn as qid, text as query from conversations where role = 'user'
  union all select 'b' || item_id, text from benchmark)"""
TICKETS = "tickets as (select o_orderkey as id, 'Order ' || o_orderkey as title, 'customer ' || o_custkey || ' priority ' || o_orderpriority as description, o_orderstatus as status, o_orderpriority as priority, o_orderdate as created from orders)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def hits_sql(words: str, content: str = "content") -> str:
    return " + ".join(f"cast(contains(lower({content}), '{w}') as bigint)" for w in dict.fromkeys(words.split()))


# Scans


@query(f"with {DOCS} select id, {hits_sql(KEYWORDS)} as hits from docs where contains(lower(content), '{KEYWORDS}') or {hits_sql(KEYWORDS)} > 0 order by seq limit 50")
def scan_docs_keyword(spark, d):
    return retrieval.keyword_scan(tables.docs(spark, d), KEYWORDS, 50).select("id", F.col("hits").cast("long").alias("hits"))


@query(f"with {DOCS} select id, round(({hits_sql(KEYWORDS)}) / 4.0, 6) as score from docs where {hits_sql(KEYWORDS)} > 0 order by ({hits_sql(KEYWORDS)}) desc, seq limit 25")
def scan_docs_ranked(spark, d):
    return retrieval.ranked_scan(tables.docs(spark, d), KEYWORDS, 25).select("id", r6("score").alias("score"))


@query("select doc_id as id, source, n_chars from documents where doc_id = 42")
def doc_lookup(spark, d):
    return retrieval.get(tables.read(spark, d, "documents").withColumn("seq", F.col("doc_id")), 42, "doc_id").select(F.col("doc_id").alias("id"), "source", "n_chars")


@query(f"with {EVENTS} select id, service, severity from ev where contains(lower(message), 'click') and service = 'svc3' order by seq limit 40")
def scan_events_filtered(spark, d):
    return retrieval.search_events(tables.events(spark, d), "click", service="svc3", limit=40).select("id", "service", "severity")


@query(f"with {EVENTS} select id, severity from ev where contains(lower(message), 'error') and severity = 'critical' order by ts desc, id limit 30")
def events_recent(spark, d):
    return retrieval.search_events(tables.events(spark, d), "error", severity="critical", limit=30, newest=True).select("id", "severity")


@query(f"with {EVENTS} select id, round(value, 6) as value from ev where metric_name = 'purchase' order by seq limit 30")
def scan_metrics(spark, d):
    return retrieval.search_metrics(tables.events(spark, d), "purchase", limit=30).select("id", r6("value").alias("value"))


@query(f"with {TICKETS} select id, status, priority from tickets where (contains(lower(title), '7') or contains(lower(description), '7')) and status = 'O' order by created desc, id limit 40")
def ticket_search(spark, d):
    return retrieval.search_tickets(tables.tickets(spark, d), "7", status="O", limit=40, newest=True).select("id", "status", "priority")


@query("select distinct event_type as value from events where event_type is not null")
def label_values(spark, d):
    return retrieval.label_values(tables.events(spark, d), "metric_name")


@query("""with q as (select embedding as e from embeddings where vec_id = 0), s as (
  select vec_id as id, label, list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), list_transform((select e from q), lambda x: cast(x as double))) as score from embeddings)
select id, label, round(score, 6) as score from s order by score desc, id limit 20""")
def vector_topk(spark, d):
    e = tables.read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    probe = e.where("id = 0").select("embedding").first()[0]  # the query's one vector
    return retrieval.vector_scan(e, probe, 20).select("id", "label", r6("score").alias("score"))


@query("""with q as (select embedding as e from embeddings where vec_id = 0)
select vec_id as id, round(list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), list_transform((select e from q), lambda x: cast(x as double))), 6) as score
from embeddings where label = 3 and list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), list_transform((select e from q), lambda x: cast(x as double))) >= -0.05""")
def vector_filtered(spark, d):
    e = tables.read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    probe = e.where("id = 0").select("embedding").first()[0]
    return retrieval.vector_scan(e, probe, None, threshold=-0.05, filters={"label": 3}).select("id", r6("score").alias("score"))


@query("""with q as (select vec_id as qid, list_transform(embedding, lambda x: cast(x as double)) as q from embeddings where vec_id < 3),
p as (select label, qid, max(list_dot_product(q, list_transform(embedding, lambda x: cast(x as double)))) as best from embeddings, q group by label, qid)
select label, round(sum(best), 6) as score from p group by label""")
def maxsim_labels(spark, d):
    e = tables.read(spark, d, "embeddings")
    probes = [r[0] for r in e.where("vec_id < 3").orderBy("vec_id").select("embedding").collect()]  # three vectors
    best = [F.max(retrieval.dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in p)))) for p in probes]
    return e.groupBy("label").agg(r6(sum(best[1:], best[0])).alias("score"))


# Text functions


@query("select doc_id as id, case when length(regexp_replace(text, '[^Ѐ-ԯ]', '', 'g')) > 2 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) then 'ru' when length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 2 * length(regexp_replace(text, '[^Ѐ-ԯ]', '', 'g')) then 'en' else 'unknown' end as script from documents")
def script_language(spark, d):
    return tables.docs(spark, d).select("id", text.script_language(F.col("content")).alias("script"))


@query(r"select doc_id as id, sha256(trim(regexp_replace(regexp_replace(text, '[\t\n\r]+', ' ', 'g'), ' {2,}', ' ', 'g'))) as clean from documents")
def normalize_ws(spark, d):
    return tables.docs(spark, d).select("id", F.sha2(text.clean_whitespace(F.col("content")), 256).alias("clean"))


STOPS = ", ".join(f"'{w}'" for w in text.STOP_EN)


@query(rf"select doc_id as id, sha256(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '' and not list_contains([{STOPS}], lower(w))), ' ')) as rest from documents")
def remove_stopwords(spark, d):
    return tables.docs(spark, d).select("id", F.sha2(text.remove_stop_words(F.col("content"), "en"), 256).alias("rest"))


@query(r"""with s as (select doc_id as id, list_filter(list_transform(string_split_regex(text, '[.!?]+\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as s from documents)
select id, cast(len(s) as bigint) as n, sha256(array_to_string(s, '|')) as joined from s""")
def split_sentences(spark, d):
    s = tables.docs(spark, d).select("id", text.split_sentences(F.col("content")).alias("s"))
    return s.select("id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("joined"))


@query(r"""with w as (select doc_id as id, list_filter(list_transform(string_split_regex(text, '\s+'), lambda x: regexp_replace(x, '[.,!?;:()\[\]{}"'']+$', '')), lambda x: regexp_matches(x, '^\p{Lu}') and length(x) > 1) as n from documents)
select id, cast(len(n) as bigint) as names, coalesce(n[1], '') as first_name from w""")
def capitalised_entities(spark, d):
    w = tables.docs(spark, d).select("id", text.capitalised(F.col("content")).alias("n"))
    return w.select("id", F.size("n").cast("long").alias("names"), F.coalesce(F.get("n", F.lit(0)), F.lit("")).alias("first_name"))


@query("select doc_id as id, substr(sha256(source || ':' || doc_id), 1, 16) as chunk_id, substr(sha256(text), 1, 16) as content_id from documents")
def hash_ids(spark, d):
    return tables.docs(spark, d).select("id", text.hash_id(F.col("source"), F.col("id").cast("string")).alias("chunk_id"), text.hash_id(F.col("content")).alias("content_id"))


@query("select doc_id as id, cast(length(substr(text, 1, 8000)) as bigint) as n, substr(text, 1, 40) as head from documents")
def truncate_embedding(spark, d):
    t = text.truncate_for_embedding(F.col("content"), 2000)
    return tables.docs(spark, d).select("id", F.length(t).cast("long").alias("n"), F.substring(t, 1, 40).alias("head"))


def count_words(found: list[str]) -> str:
    return " + ".join(f"cast(contains(t, '{w}') as bigint)" for w in found)


@query(f"""with x as (select conv_id, turn, lower(text) as t from conversations), y as (select conv_id, turn, {count_words(text.POSITIVE)} as p, {count_words(text.NEGATIVE)} as n from x)
select conv_id, turn, case when p > n then 'positive' when n > p then 'negative' else 'neutral' end as sentiment, round(case when p > n then least(0.5 + p * 0.15, 0.95) when n > p then greatest(0.5 - n * 0.15, 0.05) else 0.5 end, 6) as score from y""")
def sentiment(spark, d):
    label, score = text.sentiment(F.col("text"))
    return tables.read(spark, d, "conversations").select("conv_id", "turn", label.alias("sentiment"), r6(score).alias("score"))


def sanitized_sql() -> str:
    out = "text"
    for p in text.INJECTIONS:
        out = f"regexp_replace({out}, '{p}', '[FILTERED]', 'gi')"
    return out


@query(f"select conv_id, turn, sha256({sanitized_sql()}) as safe from conversations")
def sanitize_prompts(spark, d):
    return tables.read(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.sanitize_prompt(F.col("text")), 256).alias("safe"))


@query(r"select doc_id as id, sha256(regexp_replace(regexp_replace(nfc_normalize(strip_accents(lower(coalesce(text, '')))), '\s+', ' ', 'g'), '^ | $', '', 'g')) as folded from documents")
def normalize_unicode(spark, d):
    return tables.docs(spark, d).select("id", F.sha2(text.normalize_text(F.col("content")), 256).alias("folded"))


# Classification


def intent_sql() -> str:
    cases = [f"case when regexp_matches(query, '(?i)(?:{'|'.join(p)})') then '{name}' end" for name, p in classify.INTENTS.items()]
    return "[" + ", ".join(cases) + ", case when n > 10 then 'complex' end]"


WORDS_SQL = r"cast(len(list_filter(string_split_regex(query, '\s+'), lambda w: w <> '')) as bigint)"


def any_sql(found: list[str], c: str = "query") -> str:
    return "(" + " or ".join(f"contains(lower({c}), '{w}')" for w in found) + ")"


CLASSIFIED = f"""{ASK}, w as (select qid, query, {WORDS_SQL} as n from ask), i as (select *, list_filter({intent_sql()}, lambda x: x is not null) as l0 from w),
j as (select *, case when len(l0) > 0 then l0 else ['fact'] end as l from i),
k as (select *, case when list_contains(l, 'relationship') or list_contains(l, 'causal') then 'multi_hop' when list_contains(l, 'code_relationship') or len(l) > 1 then 'hybrid' when l[1] in ('code', 'list') then 'cascade' when l[1] = 'fact' then 'iterative' else 'vector_only' end as strategy,
  n / 10.0 + cast({any_sql(classify.COMPARISON)} as int) + 0.5 * cast({any_sql(classify.NEGATION)} as int) + 0.5 * cast({any_sql(classify.AGGREGATION)} as int) as c from j)"""


@query(f"with {CLASSIFIED} select qid, array_to_string(l, ',') as intents, l[1] as primary_intent, strategy, case when c >= 2 then 'high' when c >= 1 then 'medium' else 'low' end as complexity from k")
def classify_queries(spark, d):
    c = classify.classify(tables.queries(spark, d))
    return c.select("qid", F.array_join("intents", ",").alias("intents"), "primary_intent", "strategy", "complexity")


TOOLS_SQL = "list_filter([" + ", ".join(f"case when {any_sql(w)} then '{n}' end" for n, w in classify.TOOLING.items()) + "], lambda x: x is not null)"


@query(f"""with {CLASSIFIED} select qid, array_to_string(list_concat(case strategy when 'hybrid' then ['code', 'graph', 'docs'] when 'multi_hop' then ['graph', 'code'] when 'vector_only' then ['code', 'docs']
 else list_concat(case when l[1] in ('fact', 'list', 'documentation') then ['code', 'docs'] else [] end, case when l[1] in ('relationship', 'causal', 'code_relationship') then ['graph'] else [] end) end,
 case when l[1] <> 'tooling' then [] when len({TOOLS_SQL}) > 0 then {TOOLS_SQL} else ['kubernetes'] end), ',') as sources from k""")
def query_sources(spark, d):
    return classify.classify(tables.queries(spark, d)).select("qid", F.array_join("sources", ",").alias("sources"))


@query(f"with {CLASSIFIED} select qid, round(c, 6) as score from k")
def query_complexity(spark, d):
    return tables.queries(spark, d).select("qid", r6(classify.complexity_score(F.col("query"))).alias("score"))


@query(f"with {ASK} select qid, " + ", ".join(f"{any_sql(w)} as {n}" for n, w in classify.FEATURES.items()) + " from ask")
def query_features(spark, d):
    return classify.features(tables.queries(spark, d)).drop("query")


# Telemetry and aggregates


@query(f"with {EVENTS} select metric_name as key, count(*) as doc_count, round(avg(value), 6) as avg, round(max(value), 6) as max, round(min(value), 6) as min, count(value) as values from ev group by 1")
def metric_terms_agg(spark, d):
    m = telemetry.metric_terms(tables.events(spark, d))
    return m.select("key", "doc_count", r6("avg").alias("avg"), r6("max").alias("max"), r6("min").alias("min"), "values")


@query("select source as key, count(*) as doc_count from documents group by 1 order by 2 desc, 1 limit 10")
def field_terms(spark, d):
    return telemetry.terms(tables.docs(spark, d), "source")


@query(f"""with {EVENTS}, r as (select metric_name, value, row_number() over (partition by metric_name order by id desc) as r from ev where value is not null),
s as (select metric_name, value, row_number() over (partition by metric_name order by value) - 1 as i, count(*) over (partition by metric_name) as n from r where r <= 10000)
select metric_name, n as count, round(max(case when i = least(cast(floor(n * 0.5) as bigint), n - 1) then value end), 6) as p50, round(max(case when i = least(cast(floor(n * 0.95) as bigint), n - 1) then value end), 6) as p95, round(max(case when i = least(cast(floor(n * 0.99) as bigint), n - 1) then value end), 6) as p99 from s group by 1, 2""")
def latency_percentiles(spark, d):
    p = telemetry.percentiles(tables.events(spark, d), "metric_name", "value", "id")
    return p.select("metric_name", "count", *(r6(c).alias(c) for c in ("p50", "p95", "p99")))


@query(f"with {EVENTS} select service, round(sum(value), 4) as total, round(max_by(value, id), 6) as last from ev group by 1")
def counters_gauges(spark, d):
    c = telemetry.counters(tables.events(spark, d), "service", "value", "id")
    return c.select("service", F.round("total", 4).alias("total"), r6("last").alias("last"))


@query(f"with {EVENTS} select service, cast(epoch(time_bucket(interval '1 hour', ts)) as bigint) as at, round(max_by(value, (ts, id)), 6) as value from ev group by 1, 2")
def range_series(spark, d):
    g = telemetry.range_series(tables.events(spark, d), "service", "value", "ts", "1 hour", "id")
    return g.select("service", F.unix_timestamp(F.col("at").cast("timestamp")).alias("at"), r6("value").alias("value"))


@query(f"with {EVENTS} select service, metric_name, round(max_by(value, (ts, id)), 6) as value from ev group by 1, 2")
def instant_series(spark, d):
    return telemetry.instant(tables.events(spark, d), ["service", "metric_name"], "value", "ts", "id").select("service", "metric_name", r6("value").alias("value"))


@query(f"""with {EVENTS}, s as (select id, user_id, cast(floor(epoch(ts)) as bigint) as s from ev)
select id, count(*) over w as recent, count(*) over w <= 2 as allowed from s window w as (partition by user_id order by s range between 3599 preceding and current row)""")
def rate_limit_window(spark, d):
    r = telemetry.rate_limit(tables.events(spark, d), "user_id", "ts", "id", 2, 3600)
    return r.select("id", "recent", "allowed")


@query("select event_id as id, round(value, 6) as value from events where value > 2.0 * 40")
def anomaly_threshold(spark, d):
    return telemetry.anomalies(tables.events(spark, d), baseline=F.lit(40.0), sensitivity="high").select("id", r6("value").alias("value"))


@query(f"with {EVENTS} select id, service, 'open' as status, 'availability' as category from ev where severity = 'critical'")
def incidents(spark, d):
    return telemetry.incidents(tables.events(spark, d)).select("id", "service", "status", "category")


@query(f"with {EVENTS} select cast(epoch(date_trunc('day', ts)) as bigint) as start, metric_name, count(*) as n, round(sum(value), 4) as total from ev group by 1, 2")
def events_windowed(spark, d):
    w = telemetry.tumbling(tables.events(spark, d), "ts", "1 day", "metric_name")
    return w.select(F.unix_timestamp("start").alias("start"), "metric_name", "n", F.round("total", 4).alias("total"))


@query("""with l as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval '6 hours' then 1 else 0 end as s from events window w as (partition by user_id order by ts, event_id)),
g as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as g from (select * from l order by user_id, ts, s desc))
select user_id, cast(floor(epoch(min(ts))) as bigint) as start, cast(floor(epoch(max(ts))) as bigint) as last, count(*) as n from g group by user_id, g""")
def events_sessions(spark, d):
    s = telemetry.sessions(tables.events(spark, d), "user_id", "ts", "6 hours")
    return s.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("last").alias("last"), "n")


@query("""with o as (select o_custkey as customer, o_totalprice as v, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders)
select customer, round(sum(v * pow(0.5, r)) + 1e-7, 4) as average from o group by 1""")
def running_average(spark, d):
    """Halved cents often end in a five; the last bit of a sum must not round them, hence the 1e-7."""
    return half_averages(spark, d).select("customer", F.round(F.col("average") + 1e-7, 4).alias("average"))


def half_averages(spark, d):
    o = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.struct("o_orderdate", "o_orderkey").alias("o"), F.col("o_totalprice").alias("v"))
    return telemetry.running_half_average(o, "customer", "v", "o")


@query()
def running_average_all(spark, d):
    return half_averages(spark, d).select("customer", F.round("average", 4).alias("average"))


@query("select o_custkey as customer, max_by(o_orderkey, (o_orderdate, o_orderkey)) as latest, max_by(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders group by 1")
def doc_versions_latest(spark, d):
    o = tables.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("v"))
    return telemetry.latest_versions(o, "o_custkey", "v").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("latest"), F.col("o_orderstatus").alias("status"))


@query("""with n as (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as next from conversations)
select conv_id, turn, role from n where role = next""")
def repeated_steps(spark, d):
    return telemetry.repeated_steps(tables.read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "turn", "role")


@query("select round(sum(case when event_type = 'view' then 1 else 0 end) / cast(sum(case when event_type in ('view', 'click') then 1 else 0 end) as double), 4) as hit_rate, round(count(distinct user_id) / 500.0 * 100.0, 1) as utilisation from events")
def cache_stats(spark, d):
    count = lambda t: F.sum((F.col("event_type") == t).cast("long"))
    rate, used = telemetry.cache_stats(count("view"), count("click"), F.countDistinct("user_id"))
    return tables.read(spark, d, "events").agg(rate.alias("hit_rate"), used.alias("utilisation"))


# Fusion and reranking

SOURCES_SQL = f"""{DOCS}, {EVENTS},
a as (select 'docs' as source, cast(id as varchar) as id, content, ({hits_sql('that the over')}) / 3.0 as score, row_number() over (order by ({hits_sql('that the over')}) desc, seq) as rn from docs where {hits_sql('that the over')} > 0 qualify rn <= 30),
b as (select 'code' as source, cast(id as varchar) as id, message as content, round(value, 3) as score, row_number() over (order by value desc, id) as rn from ev qualify rn <= 20),
c as (select 'graph' as source, 'nation:' || n_nationkey as id, n_name as content, cast(n_regionkey as double) as score, row_number() over (order by n_regionkey desc, n_nationkey) as rn from nation),
s as (select * from a union all select * from b union all select * from c),
w as (select *, rn as seq, case source when 'graph' then 0.4 else 0.3 end as w, min(score) over (partition by source) as lo, max(score) over (partition by source) as hi from s)"""


def ranked_sources(spark, d) -> DataFrame:
    docs = retrieval.ranked_scan(tables.docs(spark, d), "that the over", 30)
    a = docs.select(F.lit("docs").alias("source"), F.col("id").cast("string").alias("id"), "content", "score", F.row_number().over(Window.orderBy(F.desc("score"), "seq")).alias("seq"))
    e = tables.events(spark, d).orderBy(F.desc("value"), "id").limit(20)
    b = e.select(F.lit("code").alias("source"), F.col("id").cast("string").alias("id"), F.col("message").alias("content"), F.round("value", 3).alias("score"), F.row_number().over(Window.orderBy(F.desc("value"), "id")).alias("seq"))
    n = tables.read(spark, d, "nation")
    c = n.select(F.lit("graph").alias("source"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("content"), F.col("n_regionkey").cast("double").alias("score"), F.row_number().over(Window.orderBy(F.desc("n_regionkey"), "n_nationkey")).alias("seq"))
    return a.unionByName(b).unionByName(c)


def fused_columns(f: DataFrame) -> DataFrame:
    return f.select("source", "id", r6("fused_score").alias("score"))


@query(f"with {SOURCES_SQL} select source, id, round(sum(w / (60 + seq)), 6) as score from w group by 1, 2")
def fusion_rrf(spark, d):
    return fused_columns(fusion.rrf(ranked_sources(spark, d)))


@query(f"with {SOURCES_SQL} select source, id, round(sum(w * (score - lo) / greatest(hi - lo, 1e-9)), 6) as score from w group by 1, 2")
def fusion_score_norm(spark, d):
    return fused_columns(fusion.score_normalised(ranked_sources(spark, d)))


@query(f"with {SOURCES_SQL} select source, id, round(sum(w * score), 6) as score from w group by 1, 2")
def fusion_weighted(spark, d):
    return fused_columns(fusion.weighted(ranked_sources(spark, d)))


@query(f"with {SOURCES_SQL} select source, sha256(substr(content, 1, 100)) as prefix, round(sum(w / (60 + seq) + w * (score - lo) / greatest(hi - lo, 1e-9)), 6) as score from w group by 1, 2")
def fusion_combined(spark, d):
    return fusion.combined(ranked_sources(spark, d)).select("source", F.sha2("prefix", 256).alias("prefix"), r6("fused_score").alias("score"))


@query("select min(doc_id) as id, source from documents group by source, substr(text, 1, 100)")
def dedup_keep_first(spark, d):
    return fusion.keep_first(tables.docs(spark, d), F.col("source"), F.substring("content", 1, 100)).select("id", "source")


@query(f"""with {DOCS}, x as (select id, {hits_sql('that the')} as a, {hits_sql('over with')} as b from docs)
select id, round((a / 2.0 + b / 2.0) / 2, 6) as score from x where a > 0 and b > 0 union all select id, round(a / 2.0, 6) from x where a > 0 and b = 0 union all select id, round(b / 2.0, 6) from x where a = 0 and b > 0""")
def rerank_ensemble(spark, d):
    docs = tables.docs(spark, d)
    one = lambda q: docs.select("id", "content", (retrieval.hits(F.col("content"), q) / 2.0).alias("score")).where("score > 0")
    return fusion.ensemble([one("that the"), one("over with")]).select("id", r6("score").alias("score"))


@query(f"with {DOCS}, x as (select id, {hits_sql('that the over with')} as a from docs) select id, round(a / 4.0, 6) as score from x where a > 0 order by a desc, id limit 10")
def rerank_cascade(spark, d):
    docs = tables.docs(spark, d).withColumn("score", F.lit(0.5))
    by = lambda q: lambda r: r.withColumn("score", retrieval.hits(F.col("content"), q) / 4.0).where("score > 0").orderBy(F.desc("score"), "id")
    return fusion.cascade(docs, [by("that the over with"), by("nowhere-to-be-found")]).select("id", r6("score").alias("score"))


# Graph


@query(f"with {NODES}, {EDGES} select a.name as source, e.type, b.name as target from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst where contains(a.name, '1') or contains(b.name, '1')")
def graph_one_hop(spark, d):
    return graph.one_hop(tables.nodes(spark, d), tables.edges(spark, d), "1")


@query(f"""with recursive {NODES}, {EDGES}, st as (select src as a, dst as b, src || '>' || type || '>' || dst as e from edges union all select dst, src, src || '>' || type || '>' || dst from edges),
p as (select id as node, 0 as hops, [id] as n, cast([] as varchar[]) as u from nodes where type = 'region' union all select st.b, hops + 1, list_append(n, st.b), list_append(u, st.e) from p join st on st.a = p.node where hops < 2 and not list_contains(u, st.e))
select cast(hops as bigint) as hops, array_to_string(n, '|') as path from p where hops > 0""")
def graph_paths(spark, d):
    p = graph.paths(tables.nodes(spark, d).where("type = 'region'"), tables.edges(spark, d), 2, "both")
    return p.select(F.col("hops").cast("long").alias("hops"), F.array_join("nodes", "|").alias("path"))


@query(f"""with recursive {NODES}, {EDGES}, st as (select src as a, dst as b from edges union select dst, src from edges),
p as (select 'region:1' as node, 0 as dist union select st.b, dist + 1 from p join st on st.a = p.node where dist < 3)
select node, cast(min(dist) as bigint) as distance from p where node <> 'region:1' group by node""")
def graph_neighborhood(spark, d):
    n = graph.neighbourhood(tables.nodes(spark, d).where("id = 'region:1'"), tables.edges(spark, d), 3)
    return n.select("node", F.col("distance").cast("long").alias("distance"))


@query(f"""with recursive {NODES}, {EDGES}, p as (select id as node, 0 as hops, id as path from nodes where contains(name, 'A') union all select e.dst, hops + 1, path || '|' || e.dst from p join edges e on e.src = p.node where hops < 3)
select distinct cast(hops as bigint) as hops, path from p where hops > 0 order by hops, path limit 50""")
def graph_multi_hop(spark, d):
    return graph.multi_hop(tables.nodes(spark, d), tables.edges(spark, d), "A").select(F.col("hops").cast("long").alias("hops"), "path")


@query(f"""with recursive {EDGES}, st as (select src as a, dst as b, src || '>' || type || '>' || dst as e from edges union all select dst, src, src || '>' || type || '>' || dst from edges),
p as (select 'nation:1' as node, 0 as hops, 'nation:1' as path, cast([] as varchar[]) as u union all select st.b, hops + 1, path || '|' || st.b, list_append(u, st.e) from p join st on st.a = p.node where hops < 4 and not list_contains(u, st.e))
select cast(hops as bigint) as hops, path from p where node = 'nation:6' and hops > 0""")
def graph_path_find(spark, d):
    f = graph.shortest_paths(tables.edges(spark, d), "nation:1", "nation:6", 4, "both")
    return f.select(F.col("hops").cast("long").alias("hops"), "path")


@query(f"with {NODES}, {EDGES} select 'node' as what, type, count(*) as n from nodes group by 2 union all select 'edge', type, count(*) from edges group by 2")
def graph_stats(spark, d):
    n, e = (t.groupBy("type").agg(F.count("*").alias("n")) for t in (tables.nodes(spark, d), tables.edges(spark, d)))
    return n.select(F.lit("node").alias("what"), "type", "n").unionByName(e.select(F.lit("edge").alias("what"), "type", "n"))


@query(f"""with {NODES}, {EDGES}, g as (select src, count(*) as n, array_to_string(list_sort(list(dst)), ',') as t from edges group by src)
select id, name, coalesce(n, 0) as n_edges, coalesce(t, '') as targets from nodes left join g on id = src""")
def optional_match(spark, d):
    return graph.optional_match(tables.nodes(spark, d), tables.edges(spark, d))


@query(f"with {CALLS} select distinct src as name, cast(1 as bigint) as distance from calls where dst = 'fn100'")
def callers(spark, d):
    return graph.callers(tables.code_edges(spark, d), "fn100").select("name", F.col("distance").cast("long").alias("distance"))


@query(f"""with recursive {CALLS}, p as (select 'fn200' as node, 0 as dist union select c.src, dist + 1 from p join calls c on c.dst = p.node where dist < 10)
select node as name, cast(min(dist) as bigint) as distance from p where node <> 'fn200' group by 1""")
def all_callers(spark, d):
    return graph.callers(tables.code_edges(spark, d), "fn200", 10).select("name", F.col("distance").cast("long").alias("distance"))


@query(f"""with recursive {CALLS}, p as (select 'fn3' as node, 0 as dist union select c.dst, dist + 1 from p join calls c on c.src = p.node where dist < 4)
select node as name, cast(min(dist) as bigint) as distance from p where node <> 'fn3' group by 1""")
def all_callees(spark, d):
    return graph.callees(tables.code_edges(spark, d), "fn3", 4).select("name", F.col("distance").cast("long").alias("distance"))


@query(f"with {CALLS} select 'fn' || p_partkey as name from part where 'fn' || p_partkey not in (select dst from calls)")
def dead_nodes(spark, d):
    f = tables.read(spark, d, "part").select(F.concat(F.lit("fn"), F.col("p_partkey").cast("string")).alias("name"))
    return graph.dead_code(f, tables.code_edges(spark, d))


@query("""with m as (select n_regionkey as r, 'region:' || n_regionkey as id from nation union select n_regionkey, 'nation:' || n_nationkey from nation
union all select n_regionkey, 'supplier:' || s_suppkey from supplier join nation on n_nationkey = s_nationkey union all select n_regionkey, 'customer:' || c_custkey from customer join nation on n_nationkey = c_nationkey)
select id, min(id) over (partition by r) as community from m""")
def connected_components(spark, d):
    return connected_components_all(spark, d)


@query()
def connected_components_all(spark, d):
    """``connected_components`` over every edge: customers and regions too."""
    return graph.communities(tables.edges(spark, d)).select("id", "community")


@query("""with e as (select distinct c_nationkey as id, c_mktsegment as kind from customer)
select cast(a.id as bigint) as a, cast(b.id as bigint) as b, count(*) as shared from e a join e b on a.kind = b.kind where a.id <> b.id group by 1, 2""")
def similar_structural(spark, d):
    c = tables.read(spark, d, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return graph.similar_by_type(c).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "shared")


@query("""with r as (select 'wide' as pattern, unnest(['click', 'view', 'purchase', 'error', 'signup']) as e union all select 'basic', unnest(['click', 'view'])), p as (select distinct user_id, event_type from events),
h as (select pattern, user_id, count(*) as h from r join p on e = event_type group by 1, 2)
select h.pattern, user_id as owner from h join (select pattern, count(*) as n from r group by 1) n on n.pattern = h.pattern and n.n = h.h""")
def pattern_subset(spark, d):
    need = spark.createDataFrame([("wide", x) for x in ("click", "view", "purchase", "error", "signup")] + [("basic", "click"), ("basic", "view")], "pattern string, element string")
    have = tables.read(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("element"))
    return graph.covering(need, have)


@query(f"with {NODES} select id, name from nodes where type in ('nation', 'region') and starts_with(name, 'N') or type = 'nation' and contains(name, '7')")
def node_predicates(spark, d):
    n = tables.nodes(spark, d)
    a = graph.match_nodes(n, ["nation", "region"]).where(graph.predicate("name", "STARTS WITH", "N"))
    b = graph.match_nodes(n, ["nation"]).where(graph.predicate("name", "CONTAINS", "7"))
    return a.unionByName(b).distinct().select("id", "name")


# Extraction

PERSON, TECH = extract.ENTITY_PATTERNS["person"], extract.ENTITY_PATTERNS["technology"]


def extracted_sql() -> str:
    # RE2's word borders know ASCII only: the character before a match stands in for the first, and one with a letter behind it is dropped
    def found(k: str, p: str) -> str:
        groups = ", ".join(f"regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])({p[2:]})([\\p{{L}}\\p{{N}}_]*)', {n})" for n in (1, 2))
        return f"list_transform(list_filter(list_zip({groups}), lambda z: z[2] = ''), lambda z: {{'name': z[1], 'type': '{k}'}})"

    parts = " || ".join(found(k, p) for k, p in extract.ENTITY_PATTERNS.items())
    return f"ent as (select doc_id as id, unnest(list_transform(({parts})[1:50], lambda x, i: {{'name': x.name, 'type': x.type, 'ord': i - 1}})) as e from documents)"


@query(f"with {extracted_sql()} select id, cast(e.ord as bigint) as ord, e.name, e.type from ent")
def entities_lightweight(spark, d):
    return extract.entities(tables.docs(spark, d)).select("id", F.col("ord").cast("long").alias("ord"), "name", "type")


@query(f"with {extracted_sql()} select lower(e.name) as merged, e.type as type, count(*) as mentions, min_by(e.name, (id, e.ord)) as name from ent group by 1, 2")
def entity_merge(spark, d):
    return extract.merge_entities(extract.entities(tables.docs(spark, d)))


@query(f"with {extracted_sql()} select id, e.type as type, count(*) as size, min_by(e.name, e.ord) as first, max_by(e.name, e.ord) as last from ent group by 1, 2 having count(*) >= 2")
def type_clusters(spark, d):
    return extract.type_clusters(extract.entities(tables.docs(spark, d)))


@query(r"""select page_id, cast(len(regexp_extract_all(html, '(?i)<h[1-6][\s>]')) as bigint) as headings, cast(len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) as bigint) as links,
cast(len(regexp_extract_all(html, '(?i)<li[\s>]')) as bigint) as list_items, cast(len(regexp_extract_all(html, '(?i)<table[\s>]')) as bigint) as tables,
sha256(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as text from pages""")
def html_counts(spark, d):
    return extract.html_structure(tables.read(spark, d, "pages")).withColumn("text", F.sha2("text", 256))


@query("""with l as (select page_id, unnest(list_zip(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["''][^>]*>([^<]*)</a>', 1), regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["''][^>]*>([^<]*)</a>', 2))) as x from pages),
u as (select page_id, x[1] as url, x[2] as t from l)
select page_id, 'html_link' as ref_type, case when starts_with(url, 'http') then url when starts_with(url, '/') then ltrim(url, '/') else regexp_replace(url, '\\.(md|html)$', '') end as target, t as ref_text from u where not starts_with(url, '#')""")
def crossref_links(spark, d):
    r = extract.cross_references(tables.read(spark, d, "pages"), "page_id", "html")
    return r.where("ref_type = 'html_link'")


@query(r"""select doc_id as id, 'section_ref' as ref_type, 'section:' || m as target, m as ref_text from (select doc_id, unnest(regexp_extract_all(text, '(?i)see\s+section\s+([\d.]+)') || regexp_extract_all(text, '(?i)section\s+([\d.]+)') || regexp_extract_all(text, '(?i)chapter\s+(\d+)') || regexp_extract_all(text, '(?i)appendix\s+([A-Z])')) as m from documents)
union all select doc_id, 'document_id', m, m from (select doc_id, unnest(regexp_extract_all(text, 'DOC[-_]?\d+') || regexp_extract_all(text, 'REF[-_]?\d+') || regexp_extract_all(text, '[A-Z]{2,}-\d+') || regexp_extract_all(text, '#([a-zA-Z0-9_-]+)') || regexp_extract_all(text, '§\d+(\.\d+)*')) as m from documents)""")
def crossref_documents(spark, d):
    return extract.cross_references(tables.docs(spark, d)).where("ref_type in ('section_ref', 'document_id')")


@query(r"""with i as (select page_id, unnest(regexp_extract_all(html, '(?i)<img[^>]+src="([^"]+)"', 1) || regexp_extract_all(html, '(?i)<img[^>]+src=([^\s>]+)', 1) || regexp_extract_all(html, '(?i)url\(["'']?([^"''()]+)["'']?\)', 1)) as url from pages)
select page_id, trim(url) as url from i where """ + " or ".join(f"contains(lower(url), '{e}')" for e in extract.IMAGE_ENDS))
def image_refs(spark, d):
    return extract.images(tables.read(spark, d, "pages"))


@query()
def cooccurrence(spark, d):
    return extract.cooccurrence(tables.docs(spark, d)).select("id", "a", "b", "count", r6("confidence").alias("confidence"))


# Rules and validation


@query("""with f as (select o_orderkey as e, o_orderstatus as s, o_totalprice as p from orders)
select cast(e as varchar) as entity, 'closed' as rule from f where s = 'F' and p > 200000 union all select cast(e as varchar), 'cheap' from f where p < 5000""")
def rules_eval(spark, d):
    o = tables.read(spark, d, "orders")
    feats = o.select(F.col("o_orderkey").cast("string").alias("entity"), F.explode(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.col("o_totalprice").cast("string"))).alias("feature", "value"))
    conds = spark.createDataFrame([("closed", "status", "eq", "F"), ("closed", "price", "gt", "200000"), ("cheap", "price", "lt", "5000")], "rule string, feature string, operator string, expected string")
    return rules.all_hold(feats, conds)


@query("""select cast(c_custkey as varchar) as entity, 'no_debt' as "constraint", 'error' as severity from customer where c_acctbal <> 0 and c_acctbal < 0
union all select cast(c_custkey as varchar), 'segment', 'warning' from customer where c_mktsegment <> 'BUILDING' union all select cast(c_custkey as varchar), 'rich', 'info' from customer where c_acctbal > 9000""")
def constraints_eval(spark, d):
    c = tables.read(spark, d, "customer")
    feats = c.select(F.col("c_custkey").cast("string").alias("entity"), F.explode(F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("segment"), F.col("c_mktsegment"))).alias("feature", "value"))
    cons = spark.createDataFrame([("no_debt", "balance", "lt", "0", "error"), ("segment", "segment", "eq", "BUILDING", "warning"), ("rich", "balance", "gt", "9000", "info")], "constraint string, feature string, operator string, threshold string, severity string")
    return rules.violations(feats, cons)


@query("""with s as (select cast(p_partkey as varchar) as entity, 'big' as pattern, cast(p_size > 25 as int) + cast(contains(p_type, 'BRASS') as int) as m, 0.2 as pr from part union all select cast(p_partkey as varchar), 'any', cast(p_size <> 1 as int), 0.5 from part)
select entity, pattern, cast(m as bigint) as matched, round(least(1.0, m + pr), 6) as score from s where least(1.0, m + pr) > 0.3""")
def pattern_score(spark, d):
    p = tables.read(spark, d, "part")
    feats = p.select(F.col("p_partkey").cast("string").alias("entity"), F.explode(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("kind"), F.col("p_type"))).alias("feature", "value"))
    conds = spark.createDataFrame([("big", 2, "size", "gt", "25"), ("big", 2, "kind", "contains", "BRASS"), ("any", 5, "size", "ne", "1")], "pattern string, priority int, feature string, operator string, expected string")
    return rules.pattern_scores(feats, conds).select("entity", "pattern", "matched", r6("score").alias("score"))


@query("""with m as (select s_suppkey as id, case s_suppkey % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'enterprise' end as t, case s_suppkey % 5 when 0 then 'Lambda app' when 1 then 'EKS cluster' when 2 then 'virtual hosts' when 3 then 'managed saas' else 'plain' end as a from supplier),
b as (select id, case t when 'low' then 0.5 when 'medium' then 1.0 when 'high' then 2.5 else 5.0 end as f, case a when 'Lambda app' then [30, 60, 40, 20] when 'EKS cluster' then [300, 100, 80, 50] when 'virtual hosts' then [100, 80, 50, 30] when 'managed saas' then [150, 100, 60, 40] else [100, 75, 50, 25] end as c from m)
select id, cast(floor(c[1] * f) as bigint) as compute, cast(floor(c[1] * f) + floor(c[2] * f) + floor(c[3] * f) + floor(c[4] * f) as bigint) as total from b""")
def cost_breakdown(spark, d):
    k = F.col("s_suppkey")
    t = F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high").otherwise("enterprise")
    a = F.when(k % 5 == 0, "Lambda app").when(k % 5 == 1, "EKS cluster").when(k % 5 == 2, "virtual hosts").when(k % 5 == 3, "managed saas").otherwise("plain")
    c = tables.read(spark, d, "supplier").select(k.alias("id"), rules.costs(a, t).alias("c"))
    return c.select("id", F.col("c.compute").cast("long").alias("compute"), F.col("c.total").cast("long").alias("total"))


@query("""with p as (select conv_id, turn, text as query, lead(text) over (partition by conv_id order by turn) as response, role from conversations), q as (select * from p where role = 'user' and response is not null),
t as (select *, list_filter(list_distinct(string_split_regex(lower(query), '\\s+')), lambda w: length(w) >= 4) as terms from q)
select conv_id, turn, cast(len(list_filter(terms, lambda w: not contains(lower(response), w))) as bigint) as accuracy_issues,
case when regexp_matches(response, '(?i)sudo\\s+rm|DELETE\\s+FROM|drop\\s+table|rm\\s+-rf') then false else true end as valid from t""")
def validate_response(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = tables.read(spark, d, "conversations").withColumn("response", F.lead("text").over(w)).where("role = 'user' and response is not null")
    rows = p.select("conv_id", "turn", F.col("text").alias("query"), "response", F.array(F.col("response")).alias("contexts"), F.array(F.lit(True)).alias("relevant"))
    return reasoning.validate(rows).select("conv_id", "turn", "accuracy_issues", "valid")


FACTS_SQL = f"""{DOCS}, f as (select source as qid, content, ({hits_sql(KEYWORDS)}) / 4.0 as score, row_number() over (partition by source order by ({hits_sql(KEYWORDS)}) desc, id) as rank from docs where {hits_sql(KEYWORDS)} > 0),
k as (select * from f where rank <= 5)"""


def facts(spark, d) -> DataFrame:
    s = tables.docs(spark, d).withColumn("score", retrieval.hits(F.col("content"), KEYWORDS) / 4.0).where("score > 0")
    ranks = s.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id"))).where("rank <= 5")
    return reasoning.gathered(ranks.select(F.col("source").alias("qid"), "content", "source", "score", "rank"))


@query(f"""with {FACTS_SQL} select qid, sha256(case when max(rank) = 1 then max(content) else max(case when rank = 1 then content end) || ' | ' || max(case when rank = 2 then content end) end) as answer, round(avg(score), 6) as confidence from k group by qid""")
def reason_chain(spark, d):
    return reasoning.reason(facts(spark, d), "chain").select("qid", F.sha2("answer", 256).alias("answer"), r6("confidence").alias("confidence"))


@query(f"with {FACTS_SQL} select qid, round(coalesce(avg(case when score > 0.3 then score end), 0), 6) as confidence from k group by qid")
def reason_reflect(spark, d):
    return reasoning.reason(facts(spark, d), "reflect").select("qid", r6("confidence").alias("confidence"))


@query(f"with {FACTS_SQL} select qid, round(coalesce(avg(case when score > 0.7 then score end), avg(case when rank <= 2 then score end)), 6) as confidence from k group by qid")
def reason_critique(spark, d):
    return reasoning.reason(facts(spark, d), "critique").select("qid", r6("confidence").alias("confidence"))


@query(f"with {FACTS_SQL}, g as (select qid, count(*) as n from k group by qid) select qid, 'answer (see [' || array_to_string(list_transform(range(1, n + 1), lambda i: cast(i as varchar)), ', ') || '])' as cited from g")
def citations(spark, d):
    return facts(spark, d).select("qid", reasoning.cite(F.lit("answer"), F.size("facts")).alias("cited"))


@query("""with b as (select item_id, text as t, string_split_regex(lower(text), '\\s+') as w from benchmark), a as (select item_id, lower(substr(t, 1, 60)) as a, list_filter(w, lambda x: x <> '') as w, lower(t) as lt from b)
select item_id, round(case when contains(a, lt) then 1.0 else len(list_filter(w, lambda x: contains(a, x))) / cast(greatest(len(w), 1) as double) end, 6) as correctness from a""")
def evaluate_answers(spark, d):
    b = tables.read(spark, d, "benchmark")
    return b.select("item_id", r6(reasoning.correctness(F.substring("text", 1, 60), F.col("text"))).alias("correctness"))


@query("with t as (select doc_id, quality, toxic from labels) select round(sum(case when quality = 1 and toxic = 0 then 1 else 0 end) / cast(sum(case when quality = 1 then 1 else 0 end) as double), 6) as \"precision\", round(sum(case when quality = 1 and toxic = 0 then 1 else 0 end) / cast(sum(case when toxic = 0 then 1 else 0 end) as double), 6) as recall from t")
def filter_quality(spark, d):
    both = F.sum(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    t = tables.read(spark, d, "labels")
    return t.agg(r6(both / F.sum((F.col("quality") == 1).cast("int"))).alias("precision"), r6(both / F.sum((F.col("toxic") == 0).cast("int"))).alias("recall"))


@query(f"""with {DOCS} select id, {' + '.join(f"cast(regexp_matches(content, '(?i){p.replace(chr(39), chr(39) * 2)}') as bigint)" for p, _ in reasoning.VULNERABILITIES)} as n_findings from docs""")
def vulnerability_scan(spark, d):
    return reasoning.vulnerabilities(tables.docs(spark, d)).select("id", F.size("findings").cast("long").alias("n_findings"))


# State and memory


@query("select doc_id as id from documents where doc_id % 3 = 0 or doc_id % 5 = 0")
def incremental_new_docs(spark, d):
    docs = tables.docs(spark, d)
    old = docs.where("id % 3 <> 0").select("id", ingest.content_hash(F.when(F.col("id") % 5 == 0, F.lit("old")).otherwise(F.col("content"))).alias("hash"))
    return ingest.changed(docs, old).select("id")


@query("""with t as (select conv_id || '-' || turn as key, text, case role when 'user' then 0 else 1 end as tier from conversations)
select key, cast(min(tier) as bigint) as tier from t where contains(lower(text), 'the') group by 1""")
def memory_recall(spark, d):
    c = tables.read(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.col("text").alias("value"), "role")
    r = limits.remember([c.where("role = 'user'"), c.where("role <> 'user'")], "the")
    return r.select("key", F.col("tier").cast("long").alias("tier"))


@query("""with e as (select user_id as key, max(epoch(ts)) as seen, count(*) as n from events group by 1), m as (select max(epoch(ts)) as newest from events)
select key, n from e, m where newest - seen <= 86400.0 order by seen desc, key limit 50""")
def cache_live_entries(spark, d):
    e = tables.read(spark, d, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    g = e.groupBy("key").agg(F.max("t").alias("at"), F.count("*").alias("n")).withColumn("used", F.col("at"))
    now = e.agg(F.max("t")).first()[0]
    return limits.live_entries(g, now, capacity=50, ttl=86400.0).select("key", "n")


@query()
def rate_limit_exact(spark, d):
    e = tables.read(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return limits.rate_limit(e, 2, 3600).select("client", "id", "allowed")


# Chunks


@query()
def chunk_document(spark, d):
    return chunk.chunks(tables.docs(spark, d)).select("source_id", "chunk_index", "chunk_id", F.sha2("content", 256).alias("content"), "start_char", "end_char")


@query()
def chunk_markdown(spark, d):
    return chunk.chunks(tables.docs(spark, d), "markdown").select("source_id", "chunk_index", "chunk_id", F.sha2("content", 256).alias("content"))


@query()
def chunk_structural(spark, d):
    return chunk.chunks(tables.docs(spark, d), "structural").select("source_id", "chunk_index", "heading", "path", F.sha2("content", 256).alias("content"))


# Plans


@query(f"""with {DOCS}, {EVENTS}, {NODES}, {EDGES},
a as (select 'docs' as source, cast(id as varchar) as id, row_number() over (order by ({hits_sql('that error the')}) desc, seq) as r from docs where {hits_sql('that error the')} > 0 qualify r <= 20),
b as (select 'code' as source, cast(id as varchar) as id, row_number() over (order by ({hits_sql('that error the', 'message')}) desc, seq) as r from ev where {hits_sql('that error the', 'message')} > 0 qualify r <= 20),
s as (select * from a union all select * from b)
select source, id, round(0.3 / (60 + r), 6) as score from s order by 0.3 / (60 + r) desc, source, id limit 10""")
def strategy_vector_only(spark, d):
    return fused_columns(retrieve.vector_only(spark, {k: (lambda q, n, s=s: s(q, 20)) for k, s in retrieve.standard_sources(spark, d).items()}, "that error the"))


@query()
def strategy_hybrid(spark, d):
    return fused_columns(retrieve.hybrid(spark, retrieve.standard_sources(spark, d), "nation error that"))


@query()
def strategy_cascade(spark, d):
    return fused_columns(retrieve.cascade(spark, retrieve.standard_sources(spark, d), "error that"))


@query()
def strategy_iterative(spark, d):
    return fused_columns(retrieve.iterative(spark, retrieve.standard_sources(spark, d), "error that the"))


@query()
def search_routed(spark, d):
    return fused_columns(retrieve.search(spark, retrieve.standard_sources(spark, d), "what is the reason for this error"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """One question answered from documents, events and the graph: scans, ranks, fusion, top ten."""
    return QUERIES["fusion_rrf"](spark, d).orderBy(F.desc("score"), "source", "id").limit(10)


# Plans of questions, scores of designs


def case_sql(words: dict[str, list[str]], otherwise: str) -> str:
    return "case " + " ".join(f"when {any_sql(w)} then '{n}'" for n, w in words.items()) + f" else {otherwise} end"


def named_sql(words: dict[str, list[str]], c: str = "query") -> str:
    return "list_filter([" + ", ".join(f"case when {any_sql(w, c)} then '{n}' end" for n, w in words.items()) + "], lambda x: x is not null)"


@query(f"""with {CLASSIFIED}, p as (select qid, query, {case_sql(planner.INTENT_WORDS | {"design ": planner.SKETCH_WORDS}, "case l[1] when 'causal' then 'troubleshoot' when 'complex' then 'design' else 'explain' end")} as intent, {named_sql(planner.SOURCE_WORDS)} as s from k)
select qid, trim(intent) as intent, array_to_string(case when len(s) > 0 then s else ['{"', '".join(planner.ALL_SOURCES)}'] end, ',') as sources, array_to_string({named_sql(planner.TOOL_WORDS)}, ',') as tools, array_to_string({named_sql(planner.PLATFORMS)}, ',') as platforms from p""")
def query_plans(spark, d):
    p = planner.plans(tables.queries(spark, d))
    return p.select("qid", "intent", *(F.array_join(c, ",").alias(n) for c, n in (("plan_sources", "sources"), ("tools", "tools"), ("platforms", "platforms"))))


def pattern_sql(k: int) -> str:
    return "case " + " ".join(f"when contains(id, '{p}') then {v[k]}::double" for p, v in planner.PATTERN_SCORES.items()) + f" else {planner.OTHER_SCORE}::double end"


DESIGNS = "designs as (select ['microservices', 'serverless', 'monolith', 'event-driven', 'cqrs', 'other'][cast(user_id % 6 as int) + 1] || '-' || event_id as id from events)"


@query(f"""with {DESIGNS}, c as (select id, {", ".join(f"{pattern_sql(k)} as {n}" for k, n in enumerate(planner.CRITERIA))} from designs)
select *, round((correctness + consistency + best_practices) / 3, 6) as mean, array_to_string(list_filter([case when best_practices < 0.85 then '{planner.ISSUES[0]}' end, case when consistency < 0.85 then '{planner.ISSUES[1]}' end], lambda x: x is not null), ';') as issues from c""")
def architecture_scores(spark, d):
    e = tables.read(spark, d, "events")
    kinds = F.array(*map(F.lit, [*planner.PATTERN_SCORES, "other"]))
    designs = e.select(F.concat_ws("-", F.element_at(kinds, (F.col("user_id") % 6).cast("int") + 1), F.col("event_id").cast("string")).alias("id"))
    return planner.design_scores(designs).withColumns({"mean": r6("mean"), "issues": F.array_join("issues", ";")})


@query("""select c_custkey as id, round(cast(max(case when o_orderkey is not null then 4 else 0 end) + max(case when o_orderstatus = 'F' then 3 else 0 end) + max(case when o_orderstatus = 'O' then 3 else 0 end) as double) / 10, 6) as completeness
from customer left join orders on c_custkey = o_custkey group by 1""")
def ir_completeness(spark, d):
    o = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderstatus").alias("s"))
    c = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left")
    some = lambda v: F.filter("s", lambda x: x == v)
    return c.select("id", r6(planner.completeness(F.col("s"), some("F"), some("O"))).alias("completeness"))


@query(f"with {EVENTS} select seq, substr(message, 1, 200) as pattern from ev where {any_sql(planner.ERROR_WORDS, 'message')} order by seq limit 10")
def error_patterns(spark, d):
    return planner.error_patterns(tables.events(spark, d), "message")


COMMANDS = ["MATCH (n) RETURN n", "CREATE (n:X)", "match (n) set n.a = 1", "MATCH (n) DETACH DELETE n", "RETURN 1"]


@query(f"with c as (select event_id as id, {COMMANDS}[cast(user_id % 5 as int) + 1] as c from events) select id, {any_sql([w.lower() for w in planner.WRITES], 'c')} as writes from c")
def write_guard(spark, d):
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("user_id") % 5).cast("int") + 1)
    return tables.read(spark, d, "events").select(F.col("event_id").alias("id"), planner.writes(command).alias("writes"))


@query("select l_orderkey as id, count(*) as elements, round(avg(round(l_discount * 100)), 6) as confidence, avg(round(l_discount * 100)) < 6 as low from lineitem group by 1")
def evidence_average(spark, d):
    found = planner.evidence(tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.round(F.col("l_discount") * 100).alias("c")), "id", "c", 6.0)
    return found.withColumn("confidence", r6("confidence"))


# Layout

WORDS_OF = "words as (select l_orderkey as page, l_quantity as top, l_extendedprice / 100 as x0, l_extendedprice / 100 + l_quantity as x1, l_quantity + 8 as bottom from lineitem)"
ROWS_OF = f"""{WORDS_OF}, o as (select *, row_number() over (partition by page order by top, x0, x1, bottom) as n from words),
w as (select page, top, x0, x1, bottom, n, top as anchor, cast(0 as bigint) as row from o where n = 1 union all
select o.page, o.top, o.x0, o.x1, o.bottom, o.n, case when abs(o.top - w.anchor) <= 5 then w.anchor else o.top end, case when abs(o.top - w.anchor) <= 5 then w.row else w.row + 1 end from w join o on o.page = w.page and o.n = w.n + 1),
boxes as (select page, row, min(x0) as x0, min(top) as top, max(x1) as x1, max(bottom) as bottom, count(*) as n_words from w group by 1, 2)"""


def page_words(spark, d):
    n, x = F.col("l_quantity"), F.col("l_extendedprice") / 100
    return tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("top"), x.alias("x0"), (x + n).alias("x1"), (n + 8).alias("bottom"))


@query(f"with recursive {ROWS_OF} select page, row, round(x0, 6) as x0, round(top, 6) as top, round(x1, 6) as x1, round(bottom, 6) as bottom, n_words from boxes")
def layout_rows(spark, d):
    boxes = layout.row_boxes(layout.word_rows(page_words(spark, d)))
    return boxes.select("page", "row", *(r6(c).alias(c) for c in ("x0", "top", "x1", "bottom")), "n_words")


@query(f"with recursive {ROWS_OF} select a.page, a.row as row_a, b.row as row_b from boxes a join boxes b on a.page = b.page and a.row < b.row where not (a.x1 < b.x0 or a.x0 > b.x1 or a.bottom < b.top or a.top > b.bottom)")
def layout_overlaps(spark, d):
    return layout.overlapping_rows(layout.row_boxes(layout.word_rows(page_words(spark, d))))


@query(r"""with b as (select doc_id, unnest(string_split(text, chr(10))) as t from documents), s as (select doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') as t from b)
select doc_id, case when t = '' then 'unknown' when length(t) < 100 and (upper(t) = t and lower(t) <> t or starts_with(t, '#') or regexp_matches(t, '^[A-Z][^.!?]*$')) then 'title' when regexp_matches(t, '^#{1,6}\s+') then 'heading'
when regexp_matches(t, '^\d+\.\s+') then 'list_item' when length(t) - length(replace(t, '|', '')) > 2 then 'table' when starts_with(t, '[') and ends_with(t, ']') then 'reference' else 'paragraph' end as class, count(*) as n from s group by 1, 2""")
def block_classes(spark, d):
    lines = tables.read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return lines.groupBy("doc_id", layout.block_class(F.col("t")).alias("class")).agg(F.count("*").alias("n"))


# Links between texts and entities


@query(f"""with {extracted_sql()}, c as (select doc_id as id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'chunk': i - 1, 'content': x}})) as c from documents)
select c.id, cast(c.c.chunk as int) as chunk, array_to_string((list_sort(list({{'ord': e.ord, 'name': c.id || ':' || case e.type when 'organization' then 'org' when 'technology' then 'tech' else 'person' end || '_' || e.name}})))[1:10].list_transform(lambda x: x.name), ',') as entities
from c join ent on ent.id = c.id and contains(lower(c.c.content), lower(e.name)) group by 1, 2""")
def chunk_entities(spark, d):
    docs = tables.docs(spark, d)
    chunks = docs.select("id", F.posexplode(F.split("content", "\n")).alias("chunk", "content"))
    found = linking.entities_of_chunks(chunks, extract.entities(docs))
    return found.select("id", "chunk", F.array_join("entities", ",").alias("entities"))


OUTPUTS = """outputs as (select event_id as id, case user_id % 5 when 0 then '[{"name": "N' || event_id || '", "type": "' || event_type || '"}, {"name": "B", "type": "Technology", "description": "d"}]' when 1 then '{"name": "one", "type": "person"}' when 2 then '[{"name": "broken", ' when 3 then '[]' else '[{"type": "LOCATION"}, {"name": "C"}]' end as o from events)"""


@query(f"""with {OUTPUTS}, v as (select id, case when json_valid(o) then o end as o from outputs), p as (select id, unnest(from_json(o, '[{{"name": "VARCHAR", "type": "VARCHAR", "description": "VARCHAR"}}]')) as e from v where json_type(o) = 'ARRAY')
select id, coalesce(e.name, '') as name, case when lower(e.type) in ('{"', '".join(linking.TYPES)}') then lower(e.type) else 'concept' end as type, coalesce(e.description, '') as description from p""")
def parsed_entities(spark, d):
    k = F.col("user_id") % 5
    first = F.concat(F.lit('[{"name": "N'), F.col("event_id").cast("string"), F.lit('", "type": "'), F.col("event_type"), F.lit('"}, {"name": "B", "type": "Technology", "description": "d"}]'))
    o = F.when(k == 0, first).when(k == 1, '{"name": "one", "type": "person"}').when(k == 2, '[{"name": "broken", ').when(k == 3, "[]").otherwise('[{"type": "LOCATION"}, {"name": "C"}]')
    found = tables.read(spark, d, "events").select(F.col("event_id").alias("id"), F.explode(linking.parsed_entities(o)).alias("e"))
    return found.select("id", "e.name", "e.type", "e.description")


@query("""with r as (select 'risky' as pattern, unnest(['error', 'signup']) as e union all select 'buying', unnest(['purchase', 'click']))
select distinct pattern, user_id as owner from r join events on e = event_type""")
def pattern_overlap(spark, d):
    need = spark.createDataFrame([("risky", "error"), ("risky", "signup"), ("buying", "purchase"), ("buying", "click")], "pattern string, element string")
    return linking.overlapping(need, tables.read(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("element")))


@query(f"""with {NODES}, {EDGES}, q as (select 'q' || n_nationkey as qid, [n_name, 'Region_' || n_regionkey, 'nobody'] as names from nation), u as (select qid, lower(unnest(names)) as n from q), f as (select distinct qid, id as node from u join nodes on lower(name) = n),
ends as (select src as node, dst as other, type from edges union all select dst, src, type from edges)
select f.qid, f.node, other, type, contains(lower(type), 'community') as community from f left join ends on ends.node = f.node""")
def query_entity_links(spark, d):
    n = tables.read(spark, d, "nation")
    asked = n.select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("qid"), F.array("n_name", F.concat(F.lit("Region_"), F.col("n_regionkey").cast("string")), F.lit("nobody")).alias("names"))
    return linking.linked_entities(asked, tables.nodes(spark, d), tables.edges(spark, d))


@query(f"with {EDGES}, e as (select src as id, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) select id, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from e group by 1")
def node_degrees(spark, d):
    return linking.degrees(tables.edges(spark, d))


@query(f"with {NODES} select id, type, name from nodes where type in ('nation', 'supplier') order by id limit 20 offset 15")
def node_listing(spark, d):
    return linking.page_of(tables.nodes(spark, d), ["nation", "supplier"], 15, 20).select("id", "type", "name")


from siltstone import queries_embedding, queries_graph, queries_layout, queries_plans, queries_reasoning, queries_search  # noqa: E402,F401  register their queries
