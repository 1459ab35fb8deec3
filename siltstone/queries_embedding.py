"""Queries of hashed embeddings, of the chunkers that use them, and of searches by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import chunk, diagrams, embedding, late
from siltstone.plans import retrieve
from siltstone.queries import query, r6
from siltstone.sources import tables
from siltstone.storage import cut


def hashed_sql(table: str, key: str, text: str, name: str, dims: int = embedding.DIMS) -> str:
    """Common table expressions that end in ``name``(key, i, x): the cells of each text's vector that are not 0; key may be several columns."""
    return f"""{name}_w as (select {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')) as word from {table}),
{name}_u as (select {key}, word, count(*) as n from {name}_w group by all),
{name}_f as (select word, unnest(list_concat(['<' || word || '>'], list_transform(range(1, length(word) + 1), lambda i: substr('<' || word || '>', i, 3)))) as g from (select distinct word from {name}_u)),
{name}_h as (select word, cast('0x' || substr(md5(g), 1, 15) as bigint) as h from {name}_f),
{name}_v as (select word, h % {dims} as i, sum(case when (h // {dims}) % 2 = 0 then 1 else -1 end) as s from {name}_h group by all),
{name} as materialized (select {key}, i, sum(n * s)::bigint as x from {name}_u join {name}_v using (word) group by all having sum(n * s) <> 0),
{name}_n as materialized (select {key}, sum(x * x)::double as q from {name} group by all)"""


def embedded_documents(spark, d):
    return embedding.embed_rows(tables.docs(spark, d).select("id", "content", "seq"))


@query(f"""with {hashed_sql('documents', 'doc_id', 'text', 'v')}
select doc_id as id, sha256(coalesce(text, '')) as text_hash, {embedding.DIMS}::bigint as dims, coalesce(count(x), 0)::bigint as cells, coalesce(round(sum(x * (i + 1) / sqrt(q)), 6), 0.0) as checksum
from documents left join v using (doc_id) left join v_n using (doc_id) group by doc_id, text""")
def embed_documents(spark, d):
    e = embedded_documents(spark, d)
    total = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select("id", "text_hash", F.size("embedding").cast("long").alias("dims"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("cells"), r6(total).alias("checksum"))


@query(f"""with {hashed_sql('documents', 'doc_id', 'text', 'v')},
s as (select a.doc_id as query_id, b.doc_id as id, round(sum(a.x * b.x) / (sqrt(any_value(m.q)) * sqrt(any_value(n.q))), 9) as score
  from v a join v b using (i) join v_n m on m.doc_id = a.doc_id join v_n n on n.doc_id = b.doc_id where a.doc_id % 20 = 0 group by a.doc_id, b.doc_id)
select query_id, row_number() over (partition by query_id order by score desc, id) as rank, id, round(score, 6) as score from s qualify rank <= 5""")
def embedding_neighbours(spark, d):
    e = cut(embedded_documents(spark, d).select("id", "embedding"))
    return embedding.neighbours(e, e.where("id % 20 = 0"), 5, stored=True).select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"))


ASKED = "the error that comes after a long note"


@query(f"""with {hashed_sql('documents', 'doc_id', 'text', 'v')}, asked as (select 0 as doc_id, '{ASKED}' as text), {hashed_sql('asked', 'doc_id', 'text', 'k')},
s as (select v.doc_id as id, sum(v.x * k.x) / (sqrt(any_value(m.q)) * sqrt(any_value(n.q))) as score from v join k using (i) join v_n m on m.doc_id = v.doc_id, k_n n group by v.doc_id),
r as (select id, row_number() over (order by round(score, 9) desc, id) as seq from s qualify seq <= 10)
select 'docs' as source, cast(id as varchar) as id, round(0.3 / (60 + seq), 6) as score from r""")
def strategy_embedded(spark, d):
    """The vector-only strategy over embedded documents, the query embedded by the same model."""
    docs = embedded_documents(spark, d)
    asked = embedding.Hashing()([ASKED])[0].tolist()
    sources = {"docs": retrieve.vector_source(docs, lambda q: asked, "docs")}
    return retrieve.vector_only(spark, sources, ASKED).select("source", "id", r6("fused_score").alias("score"))


@query(rf"""with p as (select doc_id as id, regexp_extract_all(text, '(?s).+?(?:[.!?]+\s+|\z)') as parts from documents where regexp_matches(coalesce(text, ''), '\S')),
s as (select id, unnest(parts) as part, unnest(range(len(parts))) as k from p),
{hashed_sql('s', 'id, k', 'part', 'v')},
w as materialized (select id, k + o as k, i, sum(x) as x from v, (values (-1), (0), (1)) t(o) group by all),
q as (select id, k, sum(x * x)::double as q from w group by all),
dots as (select a.id, a.k, sum(a.x * b.x)::double as dot from w a join w b on a.id = b.id and a.i = b.i and b.k = a.k + 1 group by all),
g as (select s.id, s.k, case when m.q > 0 and n.q > 0 then 1 - coalesce(dot, 0) / (sqrt(m.q) * sqrt(n.q)) else 1.0 end as far
  from s join s z on z.id = s.id and z.k = s.k + 1 left join q m on m.id = s.id and m.k = s.k left join q n on n.id = s.id and n.k = s.k + 1 left join dots on dots.id = s.id and dots.k = s.k),
l as (select id, list_sort(list(far)) as far from g group by id),
t as (select id, far[floor((len(far) - 1) * 0.95)::bigint + 1] as a, far[least(floor((len(far) - 1) * 0.95)::bigint + 1, len(far) - 1) + 1] as b, (len(far) - 1) * 0.95::double - floor((len(far) - 1) * 0.95::double) as f from l),
c as (select s.id, s.k, s.part, coalesce(sum(case when far > a + (b - a) * f then 1 else 0 end) over (partition by s.id order by s.k rows between unbounded preceding and 1 preceding), 0) as chunk_index
  from s left join g on g.id = s.id and g.k = s.k left join t on t.id = s.id)
select id, chunk_index::bigint as chunk_index, count(*) as n_sentences, sha256(string_agg(part, '' order by k)) as content from c group by id, chunk_index""")
def chunk_semantic(spark, d):
    c = chunk.semantic(tables.docs(spark, d))
    return c.select("id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("n_sentences").cast("long").alias("n_sentences"), F.sha2("content", 256).alias("content"))


@query("select cast(event_id as varchar) as source_id, 0::bigint as chunk_index, 'k ' || (props->>'$.k') as content, 'k' as path from events where props is not null")
def chunk_json(spark, d):
    c = chunk.chunks(tables.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("content")), "json")
    return c.select("source_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", "path")


@query()
def chunk_html(spark, d):
    c = chunk.chunks(tables.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content")), "html")
    return c.select("source_id", "chunk_index", "heading", F.length("content").alias("n_chars"))


@query()
def chunk_sentence(spark, d):
    return chunk.chunks(tables.docs(spark, d), "sentence").select("source_id", "chunk_index", "start_char", "end_char")


# Late interaction: user turns of every twentieth conversation against all documents


def asked_turns(spark, d):
    c = tables.read(spark, d, "conversations").where("role = 'user' and conv_id % 20 = 0")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("content"))


def late_index(spark, d):
    return late.build_texts(tables.docs(spark, d))


@query("""with q as (select vec_id // 4 as g, vec_id as v, list_transform(embedding, lambda x: x::double) as x from embeddings),
s as (select a.g as qid, b.g as id, a.v, max(list_dot_product(a.x, b.x)) as best from q a join q b on a.g % 20 = 0 group by a.g, b.g, a.v),
t as (select qid, id, round(sum(best), 9) as score from s group by qid, id)
select cast(qid as varchar) as qid, row_number() over (partition by qid order by score desc, id) as rank, id, round(score, 6) as score from t qualify rank <= 5""")
def late_search_vectors(spark, d):
    """Every twentieth group of four embeddings against all groups, as rows of several vectors feed the index; scored exactly."""
    e = tables.read(spark, d, "embeddings").groupBy(F.expr("vec_id div 4").alias("id")).agg(F.collect_list("embedding").alias("vectors")).withColumns({"content": F.lit("group"), "chunk_index": F.lit(0)})
    groups = diagrams.token_vectors(e, kind="double")
    out = late.search(late.build(groups, 64), groups.where("id % 20 = 0").select(F.col("id").cast("string").alias("qid"), "vectors"), 5, candidates=None)
    return out.select("qid", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"))


def words_of(table: str, key: str, text: str) -> str:
    return f"select distinct {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')) as word from {table}"


@query(f"""with asked as (select conv_id || '-' || turn as qid, text from conversations where role = 'user' and conv_id % 20 = 0),
qw as materialized ({words_of('asked', 'qid', 'text')}), dw as materialized ({words_of('documents', 'doc_id', 'text')}),
words as (select distinct word from (select word from qw union all select word from dw)),
w as (select word as own, word from words), {hashed_sql('w', 'own', 'word', 'v', late.DIMS)},
qv as materialized (select own, i, x, q from v join v_n using (own) where own in (select distinct word from qw)),
dv as materialized (select own, i, x, q from v join v_n using (own) where own in (select distinct word from dw)),
s as materialized (select a.own as q, b.own as w, sum(a.x * b.x) / (sqrt(any_value(a.q)) * sqrt(any_value(b.q))) as sim from qv a join dv b using (i) group by a.own, b.own),
z as (select qid, doc_id, qw.word, max(coalesce(sim, 0)) as best from qw cross join dw left join s on s.q = qw.word and s.w = dw.word where qw.word in (select own from v_n) and dw.word in (select own from v_n) group by qid, doc_id, qw.word),
t as (select qid, doc_id as id, round(sum(best), 9) as score from z group by qid, doc_id)
select qid, row_number() over (partition by qid order by score desc, id) as rank, id, round(score, 6) as score from t qualify rank <= 5""")
def late_search_exact(spark, d):
    queries = late.word_vectors(asked_turns(spark, d), "qid")
    return late.search(late_index(spark, d), queries, 5, candidates=None).select("qid", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"))


@query()
def late_search(spark, d):
    queries = late.word_vectors(asked_turns(spark, d), "qid")
    return late.search(late_index(spark, d), queries, 5).select("qid", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"))
