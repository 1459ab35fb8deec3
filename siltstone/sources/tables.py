"""Source tables of the engine, mapped from a folder of Parquet tables.

Every source has the reading order in ``seq``, so that limits and first-seen rules are
total orders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang", F.col("doc_id").alias("seq"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("id"),
        "ts",
        F.concat(F.lit("svc"), (F.col("user_id") % 10).cast("string")).alias("service"),
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info").alias("severity"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
        F.col("event_type").alias("metric_name"),
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("event_id").alias("seq"),
    )


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" priority "), F.col("o_orderpriority")).alias("description"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("created"),
        F.col("o_orderkey").alias("seq"),
    )


def node(table: DataFrame, kind: str, key: str, name: Column) -> DataFrame:
    return table.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), name.alias("name"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations, suppliers and customers as (id, type, name)."""
    get = lambda n: read(spark, folder, n)
    parts = [
        node(get("region"), "region", "r_regionkey", F.col("r_name")),
        node(get("nation"), "nation", "n_nationkey", F.col("n_name")),
        node(get("supplier"), "supplier", "s_suppkey", F.col("s_name")),
        node(get("customer"), "customer", "c_custkey", F.col("c_name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, type): regions contain nations, suppliers and customers are located in nations."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    n, s, c = (read(spark, folder, x) for x in ("nation", "supplier", "customer"))
    parts = [
        n.select(key("region", "n_regionkey").alias("src"), key("nation", "n_nationkey").alias("dst"), F.lit("CONTAINS").alias("type")),
        s.select(key("supplier", "s_suppkey").alias("src"), key("nation", "s_nationkey").alias("dst"), F.lit("LOCATED_IN").alias("type")),
        c.select(key("customer", "c_custkey").alias("src"), key("nation", "c_nationkey").alias("dst"), F.lit("LOCATED_IN").alias("type")),
    ]
    return reduce(DataFrame.unionByName, parts)


def code_edges(spark: SparkSession, folder: str) -> DataFrame:
    """A call graph over parts: part p calls parts 2p and 2p + 1 of the same table; multiples of 7 call nothing."""
    p = read(spark, folder, "part").select(F.col("p_partkey").alias("k"))
    name = lambda c: F.concat(F.lit("fn"), c.cast("string"))
    calls = p.where("k % 7 <> 0").select("k", F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("to"))
    return calls.join(p.select(F.col("k").alias("to")), "to", "left_semi").select(name(F.col("k")).alias("src"), name(F.col("to")).alias("dst"), F.lit("CALLS").alias("type"))


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """User turns of conversations and benchmark items as (qid, query)."""
    c = read(spark, folder, "conversations").where("role = 'user'")
    b = read(spark, folder, "benchmark")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("query")).unionByName(
        b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("query"))
    )
