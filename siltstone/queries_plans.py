"""More queries: plans with vectors, hops, entities and rerankers, diagrams, and rows for sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.operators import diagrams, fusion, retrieval
from siltstone.plans import retrieve
from siltstone.queries import EDGES, EVENTS, NODES, hits_sql, query, r6
from siltstone.queries_search import COSINE, first_vector
from siltstone.sources import readers, tables

READ = tables.read
#: Weights and places of fused rows, as the plans compute them.
FUSED = "select source, id, content, 1.0::double / (60 + seq) * case source when 'graph' then 0.4::double else 0.3::double end as score from s"


def found_sql(source: str, table: str, key: str, content: str, words: str, n: int, order: str) -> str:
    """The best n rows of a source by words of the query."""
    h = hits_sql(words, content)
    return f"(select '{source}' as source, cast({key} as varchar) as id, {content} as content, row_number() over (order by {h} desc, {order}) as seq from {table} where {h} > 0 qualify seq <= {n})"


def sources_sql(words: str, n: int) -> str:
    parts = [found_sql("docs", "documents", "doc_id", "text", words, n, "doc_id"), found_sql("code", "ev", "id", "message", words, n, "id"), found_sql("graph", "nation", "'nation:' || n_nationkey", "n_name", words, n, "n_nationkey")]
    return f"{EVENTS}, s as ({' union all '.join(parts)}), f as ({FUSED})"


def nation_docs(spark, d) -> DataFrame:
    return READ(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("content"), F.col("n_nationkey").alias("seq"))


def lexical_sources(spark, d) -> dict[str, retrieve.Source]:
    nations = lambda q, n: retrieve.rows(retrieval.ranked_scan(nation_docs(spark, d), q, n), "graph")
    return {"docs": retrieve.docs_source(tables.docs(spark, d)), "code": retrieve.events_source(tables.events(spark, d)), "graph": nations}


def by_hits(words: str):
    return lambda rows: rows.withColumn("score", retrieval.hits(F.col("content"), words) / float(len(words.split())))


# Plans


@query(f"""with {sources_sql("nation_1 error that", 20)}, t as (select * from f order by score desc, source, id limit 20), x as (select source, id, content, ({hits_sql("that error the over")}) / 4.0::double as score from t)
select row_number() over (order by score desc, source, id) as rank, source, id, round(score, 6) as score, sha256(substr(content, 1, 200)) as snippet from x order by score desc, source, id limit 10""")
def reranked_search(spark, d):
    found = retrieve.reranked(spark, {k: (lambda q, n, s=s: s(q, 20)) for k, s in lexical_sources(spark, d).items()}, "nation_1 error that", by_hits("that error the over"))
    return found.select("rank", "source", "id", r6("score").alias("score"), F.sha2("snippet", 256).alias("snippet"))


@query(f"with x as (select doc_id as id, ({hits_sql('that the over', 'text')}) / 3.0::double as score from documents) select id, round(score, 6) as score from x order by score desc, id limit 10")
def rerank_single(spark, d):
    def broken(rows: DataFrame) -> DataFrame:
        raise ConnectionError("no such provider")

    docs = tables.docs(spark, d).withColumn("score", F.lit(0.5))
    return fusion.first_reranker(docs, [broken, lambda r: by_hits("that the over")(r).orderBy(F.desc("score"), "id")]).select("id", r6("score").alias("score"))


@query(f"""with {NODES}, {EDGES}, {sources_sql("tell me that error of nation_1 and europe", 10)}, n as (select id from nodes where lower(name) in ('nation_1', 'europe')),
e as (select n.id from n join edges on edges.src = n.id union all select n.id from n join edges on edges.dst = n.id), t as (select *, row_number() over (order by score desc, source, id) as rank from f order by score desc, source, id limit 10),
a as (select * from t where contains(lower(content), 'nation_1') or contains(lower(content), 'europe')), b as (select * from a union all select * from t where not exists (select 1 from a)), g as (select * from b order by rank limit 1)
select (select string_agg(id, ',' order by id) from n) as entities, (select count(*) from e) as relations, (select count(*) from t) as n_results, sha256(content) as answer, round(score, 6) as confidence from g""")
def graph_aware_search(spark, d):
    out = retrieve.graph_aware(spark, lexical_sources(spark, d), "tell me that error of NATION_1 and EUROPE", tables.nodes(spark, d), tables.edges(spark, d))
    return out.select(F.array_join("entities", ",").alias("entities"), F.col("relations").cast("long").alias("relations"), F.size("results").cast("long").alias("n_results"), F.sha2("answer", 256).alias("answer"), r6("confidence").alias("confidence"))


def split_vectors(spark, d, part: int) -> DataFrame:
    rows = READ(spark, d, "embeddings").where(F.col("vec_id") % 2 == part)
    return rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("row "), F.col("vec_id").cast("string")).alias("content"), "embedding", F.col("vec_id").alias("seq"))


@query(f"""with v as (select case vec_id % 2 when 0 then 'docs' else 'code' end as source, cast(vec_id as varchar) as id, row_number() over (partition by vec_id % 2 order by {COSINE} desc, vec_id) as seq from embeddings qualify seq <= 10)
select source, id, round(0.3 / (60 + seq), 6) as score from v order by 0.3 / (60 + seq) desc, source, id limit 10""")
def strategy_vectors(spark, d):
    given = first_vector(spark, d)
    sources = {name: retrieve.vector_source(split_vectors(spark, d, k), lambda q: given, name) for k, name in enumerate(("docs", "code"))}
    return retrieve.vector_only(spark, sources, "any").select("source", "id", r6("fused_score").alias("score"))


@query(f"with {sources_sql('nation_1 that', 10)} select source, id, round(score, 6) as score from f where source = 'graph' order by f.score desc, id limit 10")
def strategy_graph_only(spark, d):
    return retrieve.graph_only(spark, lexical_sources(spark, d), "nation_1 that").select("source", "id", r6("fused_score").alias("score"))


@query(f"""with {NODES}, {EDGES}, z as (select id from nodes where contains(name, 'ASIA')), p as (select distinct 1 as hops, src || '|' || dst as path from z join edges on src = z.id
  union select 2, a.src || '|' || a.dst || '|' || b.dst from z join edges a on a.src = z.id join edges b on b.src = a.dst),
q as (select *, row_number() over (order by hops, path) as rn from p order by hops, path limit 10), s as (select 'graph' as source, path as id, path as content, rn as seq from q union all select * from {found_sql('docs', 'documents', 'doc_id', 'text', 'asia', 10, 'doc_id')}), f as ({FUSED})
select source, id, round(score, 6) as score from f order by f.score desc, source, id limit 10""")
def strategy_multi_hop(spark, d):
    sources = lexical_sources(spark, d) | {"hops": retrieve.hop_source(tables.nodes(spark, d), tables.edges(spark, d))}
    return retrieve.multi_hop(spark, sources, "ASIA").select("source", "id", r6("fused_score").alias("score"))


@query(f"""with {NODES}, {EDGES}, u as (select src as a, dst as b from edges union select dst, src from edges), z as (select 'region:3' as node), o as (select distinct b as node, 1 as distance from z join u on u.a = z.node),
t as (select distinct u.b as node, 2 as distance from o join u on u.a = o.node where u.b not in (select node from o) and u.b <> 'region:3'), r as (select * from o union all select * from t)
select node, name, type, distance from r join nodes on nodes.id = r.node order by distance, node limit 20""")
def entity_search(spark, d):
    return retrieve.entity_search(tables.nodes(spark, d), tables.edges(spark, d), "EUROPE").select("node", "name", "type", "distance")


# Diagrams and rows for sinks

SIGNS_SQL = "case " + " ".join(
    "when " + " + ".join("regexp_matches(t, '{}')::int".format(s.replace(r"\w", r"[\p{L}\p{M}\p{N}_]")) for s in signs) + f" >= 2 then '{kind}'" for kind, signs in diagrams.TYPE_SIGNS.items()
) + " " + " ".join("when " + " and ".join(f"contains(t, '{w}')" for w in words) + f" then '{kind}'" for words, kind in diagrams.TYPE_WORDS) + " else 'unknown' end"
#: Texts that parts take in turn: the file's name, its content, and the format.
FORMATS = [
    ("a.drawio", "", "drawio"), ("b.puml", "x", "plantuml"), ("c.mmd", "@startuml", "unknown"), ("d.xml", "<bpmn:process>", "bpmn"), ("e", "@startuml\nA -> B", "plantuml"), ("f", "graph TD", "unknown"),
    ("g.xml", "<mxfile>", "drawio"), ("h", '{"openapi": "3.0"}', "openapi"), ("i", "openapi: 3.0", "openapi"), ("j.txt", "plain words", "unknown"), ("k", '{"a": 1}', "openapi"), ("l.txt", "<bpmn:definitions>", "bpmn"),
]


@query(f"with d as (select doc_id as id, lower(text) as t from documents) select id, {SIGNS_SQL} as type from d")
def diagram_types(spark, d):
    return tables.docs(spark, d).select("id", diagrams.diagram_type(F.col("content")).alias("type"))


@query(f"select p_partkey as id, {[f for _, _, f in FORMATS]}[p_partkey % {len(FORMATS)} + 1] as format from part")
def diagram_formats(spark, d):
    at = (F.col("p_partkey") % len(FORMATS) + 1).cast("int")
    one = lambda k: F.element_at(F.array(*(F.lit(f[k]) for f in FORMATS)), at)
    return READ(spark, d, "part").select(F.col("p_partkey").alias("id"), diagrams.diagram_format(one(1), one(0)).alias("format"))


def region_diagrams(spark, d) -> DataFrame:
    """Regions as diagrams whose entities are their nations: a handful a region."""
    n = READ(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), F.lit("nation").alias("type")))).alias("entities"))
    r = READ(spark, d, "region").select(F.col("r_regionkey").alias("doc_id"), F.col("r_name").alias("content"), F.lit("map").alias("diagram_type"), F.col("r_regionkey").alias("n_regionkey"))
    return r.join(n, "n_regionkey", "left")


@query("""with n as (select n_regionkey, list(n_name order by n_name) as e from nation group by 1)
select r_regionkey as doc_id, 'map' as diagram_type, r_name as content, substr(case when len(e) > 0 then r_name || '. Entities: ' || array_to_string(e[1:10], ', ') else r_name end, 1, 2000) as combined_text from region left join n on n_regionkey = r_regionkey""")
def diagram_points(spark, d):
    return diagrams.diagram_points(region_diagrams(spark, d))


@query("select r_regionkey || ':' || n_name as id, 'nation' as type, n_name as name, 'map' as diagram_type, cast(r_regionkey as varchar) as doc_id from region join nation on n_regionkey = r_regionkey")
def diagram_nodes(spark, d):
    p = F.col("properties")
    return diagrams.diagram_nodes(region_diagrams(spark, d)).select("id", "type", *(p[c].alias(c) for c in ("name", "diagram_type", "doc_id")))


@query("select doc_id as id, sha256(cast(doc_id as varchar) || ': ' || substr(coalesce(text, ''), 1, 200)) as text, coalesce(source, 'unknown') as artifact_type, 'INDEXED' as status from documents")
def design_index(spark, d):
    return diagrams.design_index(tables.docs(spark, d).withColumnRenamed("source", "artifact_type")).withColumn("text", F.sha2("text", 256))


@query("""select vec_id // 4 as id, count(*) as n, round(sum(cast(embedding as double[])[1]), 6) as total from embeddings where (vec_id // 4) % 5 <> 0 group by 1""")
def token_vectors(spark, d):
    e = READ(spark, d, "embeddings").withColumn("id", F.expr("vec_id div 4"))
    vectors = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda v: v["embedding"])  # four at most
    chunks = e.groupBy("id").agg(vectors.alias("vectors")).withColumns({"content": F.when(F.col("id") % 5 == 0, "").otherwise("text"), "chunk_index": F.col("id")})
    total = F.aggregate("vectors", F.lit(0.0), lambda s, v: s + F.get(v, F.lit(0)).cast("double"))
    return diagrams.token_vectors(chunks).select("id", F.size("vectors").cast("long").alias("n"), r6(total).alias("total"))


PIECE = 400
#: Words are folded into one text whose pieces are parted by a character that no text holds.
PIECES_SQL = rf"""list_reduce(w, lambda a, x: a || case when length(string_split(a, chr(57344))[-1]) + (not contains(a, chr(57344)))::int + length(x) + 1 > {PIECE} then chr(57344) else ' ' end || x)"""


@query(rf"""with d as (select doc_id as id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') as w from documents), p as (select id, case when len(w) = 0 then t else {PIECES_SQL} end as p from d)
select id, cast(len(string_split(p, chr(57344))) as bigint) as n, sha256(p) as pieces from p""")
def extraction_pieces(spark, d):
    p = tables.docs(spark, d).select("id", diagrams.extraction_pieces(F.col("content"), PIECE).alias("p"))
    return p.select("id", F.size("p").cast("long").alias("n"), F.sha2(F.array_join("p", chr(57344)), 256).alias("pieces"))


@query("""select 'req/' || p_partkey || '.md' as id, p_partkey || '.md' as title, 'local' as source, 'active' as status, 'requirement' as type, substr(p_name || chr(10) || 'Acceptance criteria' || chr(10) || repeat('- must hold' || chr(10), p_size), 1, 500) as description, cast(p_size as bigint) as criteria from part""")
def requirement_files(spark, d):
    text = F.expr(r"concat(p_name, '\n', 'Acceptance criteria', '\n', repeat('- must hold\n', p_size))")
    files = READ(spark, d, "part").select(F.concat(F.lit("req/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), text.alias("content"))
    return readers.requirements(files).withColumn("criteria", F.size("criteria").cast("long"))
