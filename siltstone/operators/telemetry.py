"""Aggregates over metrics and events, windows, versions and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Times the baseline that is an anomaly, and the baseline where none is given (fixed values).
SENSITIVITY, BASELINE = {"low": 3.0, "medium": 2.5, "high": 2.0}, 100.0


def terms(rows: DataFrame, field: str, size: int = 10) -> DataFrame:
    """The most frequent values of a field."""
    return rows.groupBy(F.col(field).alias("key")).agg(F.count("*").alias("doc_count")).orderBy(F.desc("doc_count"), "key").limit(size)


def metric_terms(rows: DataFrame, key: str = "metric_name", value: str = "value", size: int = 10) -> DataFrame:
    out = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("doc_count"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), F.count(value).alias("values"))
    return out.orderBy(F.desc("doc_count"), "key").limit(size)


def newest(rows: DataFrame, group: str, order: str, last: int, salts: int = 64) -> DataFrame:
    """The last ``last`` rows of each group, in two steps: of each of ``salts`` parts of a group first, then of what they left.

    So the task that ends a group reads ``salts`` x ``last`` rows at most, however long it is.
    """
    salted = Window.partitionBy(group, "_salt").orderBy(F.desc(order))
    whole = Window.partitionBy(group).orderBy(F.desc(order))
    some = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts))).withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= last).drop("_salt", "_r")
    return some.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= last).drop("_r")


def percentiles(rows: DataFrame, group: str, value: str, order: str, last: int = 10_000, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """By group: the number of the last samples and their percentiles by index, sorted[min(int(n p), n - 1)]; samples are bounded by ``last`` a group."""
    kept = newest(rows.where(F.col(value).isNotNull()), group, order, last)
    one = kept.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("v")).withColumn("n", F.size("v"))
    at = lambda p: F.get("v", F.least(F.floor(F.col("n") * p), F.col("n") - 1).cast("int"))
    return one.select(group, F.col("n").cast("long").alias("count"), *(at(p).alias(f"p{round(p * 100)}") for p in points))


def counters(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Sum of a counter and last value of a gauge by key."""
    return rows.groupBy(key).agg(F.sum(value).alias("total"), F.max_by(value, at).alias("last"))


def range_series(rows: DataFrame, key: str, value: str, at: str, step: str, *ties: str) -> DataFrame:
    """Last value of each series in each step of time that has one; rows of one time by ``ties``."""
    last = F.max_by(value, F.struct(at, *ties))
    return rows.groupBy(key, F.window(at, step).alias("w")).agg(last.alias("value")).select(key, F.col("w.start").alias("at"), "value")


def instant(rows: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """Last value of each series."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"))


def anomalies(rows: DataFrame, value: str = "value", baseline: Column | None = None, sensitivity: str = "medium") -> DataFrame:
    base = F.coalesce(baseline, F.lit(BASELINE)) if baseline is not None else F.lit(BASELINE)
    return rows.where(F.col(value) > SENSITIVITY.get(sensitivity, 2.5) * base)


def rate_limit(calls: DataFrame, client: str, at: str, key: str, most: int = 100, seconds: int = 60) -> DataFrame:
    """Adds ``recent`` (calls of the client in the window before, this one included) and ``allowed``.

    Rejected calls count here; ``streaming.limits`` has the exact rule that forgets them.
    """
    w = Window.partitionBy(client).orderBy("_s").rangeBetween(-(seconds - 1), 0)
    return calls.withColumn("_s", F.unix_timestamp(at)).withColumn("recent", F.count(key).over(w)).withColumn("allowed", F.col("recent") <= most).drop("_s")


def latest_versions(versions: DataFrame, key: str, number: str) -> DataFrame:
    """The row of the greatest version of each key, from partial aggregates."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), number).alias("_v")).select("_v.*")


def version_at(versions: DataFrame, number: int, column: str = "version") -> DataFrame:
    return versions.where(F.col(column) == number)


#: Values beyond this many count nothing in a double: 2 to the power of -1075 is 0.
HALVINGS = 1075


def running_half_average(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """avg <- (avg + new) / 2 over each key's values in order, from 0; null if a value is.

    The newest value counts by 1/2, the one before by 1/4 and so on, so only the last
    ``HALVINGS`` of a key are looked at, in two steps. Rows come oldest first, so that the sum
    is rounded as the steps are. Order must be unique in a key.
    """
    none = rows.groupBy(key).agg(F.count_if(F.col(value).isNull()).alias("_none"))
    last = newest(rows.select(key, order, F.col(value).alias("_v")), key, order, HALVINGS)
    own = Window.partitionBy(key)
    back = F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy(order)) + 1
    total = F.sum(F.col("_v") * F.pow(F.lit(0.5), F.col("_n"))).alias("average")
    summed = last.withColumn("_n", back).groupBy(key).agg(total)
    return summed.join(none, key).select(key, F.when(F.col("_none") == 0, F.col("average")).alias("average"))


def repeated_steps(trace: DataFrame, key: str, order: str, step: str) -> DataFrame:
    """Steps that equal the next one of their trace."""
    w = Window.partitionBy(key).orderBy(order)
    return trace.withColumn("_next", F.lead(step).over(w)).where(F.col(step) == F.col("_next")).drop("_next")


def cache_stats(hits: Column, misses: Column, entries: Column, capacity: int = 500) -> tuple[Column, Column]:
    """(hit rate, utilisation in percent)."""
    total = hits + misses
    return F.round(F.when(total > 0, hits / total).otherwise(0.0), 4), F.round(entries / capacity * 100.0, 1)


def tumbling(rows: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    return rows.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Sessions of each key that end after a gap."""
    s = rows.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return s.select(key, F.col("s.start").alias("start"), "last", "n")


def incidents(alerts: DataFrame) -> DataFrame:
    return alerts.where("severity = 'critical'").withColumns({"status": F.lit("open"), "category": F.lit("availability")})
