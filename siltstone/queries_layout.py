"""Queries of page blocks, heading trees, drawings and rounds of retrieval."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import drawings, layout
from siltstone.plans import retrieve
from siltstone.queries import query, r6
from siltstone.sources import tables


def numbered_orders(spark, d):
    """Orders of each customer, numbered."""
    o = tables.read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("page"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"), "o_orderkey", F.col("o_orderkey") % 50 + 1, "o_orderstatus").toDF("page", "n", "key", "amount", "status")


def order_words(spark, d):
    """Words of a page a customer: two that stand close together a line, and a third far to the right on most lines."""
    t = numbered_orders(spark, d).withColumn("top", F.col("n") * 20.0)
    word = lambda x0, x1, text: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), text.alias("text"))
    first = F.when(F.col("status") == "F", "finished order").otherwise("Item")
    words = F.array(word(10, 40, first), word(45, 80, F.col("key").cast("string")), F.when(F.col("n") % 3 != 0, word(120, 140, F.col("amount").cast("string"))))
    return t.select("page", "top", (F.col("top") + 10).alias("bottom"), F.explode(F.array_compact(words)).alias("w")).select("page", "top", "bottom", "w.*")


@query("""with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
l as (select o_custkey as page, n, n % 3 <> 0 as wide, case o_orderstatus when 'F' then 'finished order' else 'Item' end || ' ' || o_orderkey as one, cast(o_orderkey % 50 + 1 as varchar) as two from o),
r as (select *, row_number() over (partition by page order by n) - 1 as row from l),
f as (select *, coalesce(wide and lag(wide) over (partition by page order by row), false) as follows from r),
g as (select *, max(case when not follows then row end) over (partition by page order by row rows unbounded preceding) as g from f),
t as (select *, count(*) over (partition by page, g) >= 2 and wide as in_table from g),
k as (select *, case when in_table then 'table' when starts_with(one, 'Item') then 'title' else 'paragraph' end as kind from t),
s as (select *, case when in_table and lag(in_table) over w and lag(g) over w = g then 0 when kind = 'paragraph' and lag(kind) over w = 'paragraph' and (n - lag(n) over w) * 20 - 10 <= 12 then 0 else 1 end as starts from k window w as (partition by page order by row)),
b as (select *, sum(starts) over (partition by page order by row rows unbounded preceding) - 1 as block from s)
select page, block::bigint as block, any_value(kind) as layout_type, sha256(string_agg(one || case when wide then case when in_table then chr(9) else ' ' end || two else '' end, chr(10) order by row)) as text, max(case when wide then 140 else 80 end)::double as x1, min(n) * 20.0::double as top, count(*) as n_rows from b group by page, block""")
def layout_blocks(spark, d):
    b = layout.page_blocks(order_words(spark, d))
    return b.select("page", "block", "layout_type", F.sha2("text", 256).alias("text"), "x1", "top", "n_rows")


@query("""with h as (select o_custkey as doc_id, row_number() over (partition by o_custkey order by o_orderkey) as position, o_orderkey % 6 + 1 as level, cast(o_orderkey as varchar) as text from orders)
select a.doc_id, a.position, coalesce((select max(b.position) from h b where b.doc_id = a.doc_id and b.position < a.position and b.level < a.level), 0) as parent,
  (select string_agg(c.text, '/' order by c.position) from h c where c.doc_id = a.doc_id and c.position < a.position and c.level < a.level
    and not exists (select 1 from h e where e.doc_id = c.doc_id and e.position > c.position and e.position < a.position and e.level <= c.level)) as above
from h a""")
def heading_tree(spark, d):
    h = numbered_orders(spark, d).select(F.col("page").alias("doc_id"), F.col("n").cast("long").alias("position"), (F.col("key") % 6 + 1).alias("level"), F.col("key").cast("string").alias("text"))
    t = layout.heading_tree(h)
    above = F.slice("path", 1, F.size("path") - 1)
    return t.select("doc_id", "position", F.coalesce("parent", F.lit(0)).alias("parent"), F.when(F.size(above) > 0, F.array_join(above, "/")).alias("above"))


def user_drawings(spark, d):
    """A sequence diagram a user: a lifeline for every sixth event, a message for the others."""
    e = tables.events(spark, d)
    line = F.when(F.col("id") % 6 == 0, F.concat(F.col("service"), F.lit(": the "), F.col("severity"))).otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.when(F.col("id") % 2 == 0, " --> ").otherwise(" ->> "), F.col("service"), F.lit(": "), F.col("message")))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n")
    return e.groupBy("user_id").agg(held.alias("content")).withColumnRenamed("user_id", "id")


DRAWN = "with e as (select event_id, user_id, 'svc' || cast(user_id % 10 as varchar) as service, case event_type when 'error' then 'critical' when 'purchase' then 'warning' else 'info' end as severity, event_type || ' ' || props as message, row_number() over (partition by user_id order by event_id) - 1 as ord from events)"


@query(f"{DRAWN} select user_id as id, (row_number() over (partition by user_id order by event_id) - 1)::bigint as ord, 'user' || user_id as a, service as b, case when event_id % 2 = 0 then 'async' else 'sync' end as type, message as label from e where event_id % 6 <> 0")
def drawing_messages(spark, d):
    return drawings.relations(user_drawings(spark, d), "sequence").withColumn("ord", F.col("ord").cast("long"))


@query(f"{DRAWN} select user_id as id, min(ord)::bigint as ord, 'object' as type, service as name, '' as detail from e where event_id % 6 = 0 group by user_id, service")
def drawing_lifelines(spark, d):
    return drawings.entities(user_drawings(spark, d), "sequence").withColumn("ord", F.col("ord").cast("long"))


@query()
def strategy_unseen(spark, d):
    """Rounds that ask documents, events or the graph, whichever scored best so far, for what was not seen yet."""
    found, _ = retrieve.unseen(spark, retrieve.standard_sources(spark, d), "error that the over", 10)
    return found.select("round", "source", "id", r6("score").alias("score"))


@query()
def strategy_adaptive(spark, d):
    out = retrieve.adaptive(spark, retrieve.standard_sources(spark, d), ["graph", "docs", "code"], "error that the over", "explain", 15)
    return out.select("step", "source", "id", r6("score").alias("score"))
