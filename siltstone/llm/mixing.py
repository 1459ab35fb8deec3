"""Mixing sources to target weights with histograms of hashes, with DataFrame functions only.

Every document has a key: the hexadecimal MD5 of its id and text, and a number that tells
equal rows apart. A source's budget is met epoch by epoch: whole epochs take every document,
and the last takes those whose key is below the source's threshold, so that the documents of
a smaller budget are among those of a larger one. Words are summed by source and by the
first three digits of the key; the bucket in which a source's budget ends is the only one
that is looked at again, by the next three digits, until it holds one document. Documents
are never sorted.

Sums are partially aggregated, so a source with a third of all rows costs a row a task and
bucket; the rows of boundary buckets are one in 4,096 and are written once. Thresholds are a
row a source, and Spark broadcasts them if they are small and splits hot sources otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.shared import materialise, require

#: Weights of the sources in order, repeating; the most often that a document may be taken.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Hexadecimal digits of the key that are looked at in one step, and digits of a whole key.
DIGITS, KEY = 3, 48


def words(text: Column) -> Column:
    """The number of runs of characters other than space and the five ASCII controls that break lines and fields."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``place``, the rank (from 0) of ``source`` by code point, null last; one row a source.

    Sources are dealt by ranges, ranked in their range and moved on by the ranges before, so
    that no task holds all of them.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = materialise(dealt.withColumn("_range", F.spark_partition_id()), "mix-sources")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("place", inside).join(before, "_range").withColumn("place", F.col("place") + F.col("before")).drop("_range", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """Adds ``target`` (double) to (source, source_size): shares of ``share`` x all sizes by weight, at most ``repeats`` x the source's size.

    What a source cannot take is shared anew among the others until none is above its limit;
    each turn sends two sums to the driver.
    """
    rows = numbered(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    rows = materialise(rows.withColumn("most", F.col("source_size") * repeats), "mix-weighed")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * min(share, repeats)
    rate, full = 0.0, F.lit(False)
    while True:
        seen = rows.agg(F.sum(F.when(full, F.col("most"))).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if not seen["weight"]:
            break
        rate = (total - (seen["most"] or 0)) / seen["weight"]
        above = F.col("weight") * F.lit(rate) > F.col("most")
        if rows.where(above).count() == seen["n"]:
            break
        full = above
    return rows.select("source", "source_size", F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(rate)).alias("target"))


def thresholds(rows: DataFrame, first: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, cut, whole): of a source's last epoch, documents with a key below ``cut`` are taken, and that with this key if ``whole``.

    rows: source, size, key; first: words and documents by source and ``bucket``, the first
    digits of the key; sources: source, budget. The document in which the budget ends is
    taken if that comes nearer to the budget, so a source misses it by half a document.
    """
    depth, hist, done = DIGITS, first.where("size > 0"), None
    open_rows = sources.where("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("before"), F.lit("").alias("prefix"))
    while True:
        open_rows = open_rows.withColumnRenamed("source", "_of")
        found = hist.join(open_rows, F.col("source").eqNullSafe(F.col("_of")) & (F.substring("bucket", 1, depth - DIGITS) == F.col("prefix")))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))  # at most 4,096 rows a source
        found = found.select("source", "budget", "bucket", "n", "size", (F.col("before") + upto - F.col("size")).alias("before"))
        ends = materialise(found.where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("size"))), "mix-ends")
        one = ends.where(F.col("n") == 1).select("source", "bucket", (F.col("before") * 2 + F.col("size") <= F.col("budget") * 2).alias("whole"))
        done = one if done is None else done.unionByName(one)
        open_rows = ends.where("n > 1").select("source", "budget", "before", F.col("bucket").alias("prefix"))
        if open_rows.isEmpty() or depth >= KEY:
            break
        narrowed = open_rows.select(F.col("source").alias("_of"), "prefix")
        rows = rows.join(narrowed, F.col("source").eqNullSafe(F.col("_of")) & (F.substring("key", 1, depth) == F.col("prefix")), "left_semi")
        rows = materialise(rows.where("size > 0"), "mix-boundary")
        depth += DIGITS
        hist = rows.groupBy("source", F.substring("key", 1, depth).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return done.select("source", F.col("bucket").alias("cut"), "whole")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each row of ``docs`` the mix takes, repeats counted.

    Documents are taken whole, ``taken`` is a multiple of ``size`` of at most ``repeats``. A
    null or empty text has size 0 and is taken 0 times; a null source is a source, the last
    one. Rows equal in doc_id (nulls too) and text are rows of their own: how many of them are
    taken is fixed, which ones makes no difference. Ties of keys go by their number. A source
    without words has target 0; an empty table gives an empty one. Extra columns are ignored,
    whatever their names; doc_id keeps its type.
    """
    require(docs, ["doc_id", "text", "source"])
    own = F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))), "UTF-8"))
    key = F.concat(own, F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), KEY - 32, "0"))
    rows = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), key.alias("key")), "mix-rows")
    first = materialise(rows.groupBy("source", F.substring("key", 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n")), "mix-first")
    sources = materialise(targets(first.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats, share), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    ends = thresholds(rows.select("source", "size", "key"), first, sources).withColumnRenamed("source", "_of")
    # a budget that rounding puts at the source's size has no end and takes all
    all_of = (F.col("budget") > 0) & F.col("cut").isNull()
    rules = sources.join(ends, F.col("source").eqNullSafe(F.col("_of")), "left").select(F.col("source").alias("_of"), "source_size", "target", "epochs", all_of.alias("all"), "cut", "whole")
    rules = materialise(rules, "mix-rules")
    held = F.substring("key", 1, F.length("cut"))
    again = F.col("all") | (held < F.col("cut")) | ((held == F.col("cut")) & F.col("whole"))
    taken = F.col("size") * (F.col("epochs") + F.coalesce(again, F.lit(False)).cast("long"))
    return rows.join(rules, F.col("source").eqNullSafe(F.col("_of"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
