"""Incremental ingestion: what is new or changed since the last run, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 16)


def changed(docs: DataFrame, state: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """Documents whose (key, hash) is not in ``state`` (key, hash): an anti join."""
    return docs.withColumn("hash", content_hash(F.col(content))).join(state.select(key, "hash"), [key, "hash"], "left_anti")


def next_state(docs: DataFrame, state: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """The state after the documents: new hashes take the place of old ones."""
    new = docs.select(key, content_hash(F.col(content)).alias("hash"))
    return new.unionByName(state.join(new, key, "left_anti"))


def delete_source(rows: DataFrame, source: str, key: str = "source_id") -> DataFrame:
    return rows.where(~F.col(key).eqNullSafe(F.lit(source)))


def upsert(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows in place of those with their keys."""
    return current.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def watch(folder: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feed each new batch of a streaming file source to ``sink``; with ``once``, what is there now."""
    w = folder.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def notifying(sink: Callable[[DataFrame, int], None], callbacks: list[Callable[[str, DataFrame], None]], source: str, log: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A sink for ``watch`` that tells each callback of what was ingested, after it is stored; one that fails is logged and does not stop the others."""

    def run(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        for callback in dict.fromkeys(callbacks):
            try:
                callback(source, batch)
            except Exception as e:  # noqa: BLE001  a callback is foreign code
                log(f"a callback failed for source {source}: {e}")

    return run


def normalised_logs(logs: DataFrame) -> DataFrame:
    """(at, message, level, service, source) of raw log rows (ns: nanoseconds since 1970, message, level, service, source); levels are lower-case, info where there is none."""
    level = F.coalesce(F.nullif(F.trim(F.lower("level")), F.lit("")), F.lit("info"))
    return logs.select(F.timestamp_micros(F.expr("ns div 1000")).alias("at"), F.coalesce("message", F.lit("")).alias("message"), level.alias("level"), F.coalesce("service", F.lit("unknown")).alias("service"), "source")


def windowed(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None, *keys: str) -> DataFrame:
    """Counts and sums of event-time windows; an extension with watermarks."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def telemetry_pairs(logs: DataFrame, metrics: DataFrame, before: str = "30 seconds", after: str = "30 seconds", late: str | None = "10 minutes") -> DataFrame:
    """(service, log_id, at, message, metric_id, metric_at, metric, value): metrics from ``before`` to ``after`` each log of the same service.

    logs: (id, ts, service, message), metrics: (id, ts, service, metric_name, value). The same
    join in batch (``late=None``) and as a stream; a stream forgets what watermarks say no
    later row can meet, and drops rows that come later than ``late``, which ``dropped_rows``
    counts. Rows with a null time or service meet nothing; repeated rows meet as often as they stand.
    """
    a = logs.select(F.col("id").alias("log_id"), F.col("ts").alias("at"), "service", "message")
    b = metrics.select(F.col("id").alias("metric_id"), F.col("ts").alias("metric_at"), F.col("service").alias("_service"), F.col("metric_name").alias("metric"), "value")
    if late is not None:
        a, b = a.withWatermark("at", late), b.withWatermark("metric_at", late)
    near = F.expr(f"service = _service and metric_at >= at - interval {before} and metric_at <= at + interval {after}")
    return a.join(b, near).select("service", "log_id", "at", "message", "metric_id", "metric_at", "metric", "value")


def bucketed_pairs(logs: DataFrame, metrics: DataFrame, seconds: int = 30) -> DataFrame:
    """``telemetry_pairs`` in batch for long tables: rows meet by service and time bucket, so a busy service is many keys.

    A log looks into the buckets that its interval touches, two at most.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (2_000_000 * seconds))
    width = F.expr(f"interval {seconds} seconds")
    a = logs.select(F.col("id").alias("log_id"), F.col("ts").alias("at"), "service", "message")
    a = a.withColumn("_b", F.explode(F.sequence(bucket(F.col("at") - width), bucket(F.col("at") + width))))
    b = metrics.select(F.col("id").alias("metric_id"), F.col("ts").alias("metric_at"), "service", F.col("metric_name").alias("metric"), "value").withColumn("_b", bucket(F.col("metric_at")))
    near = a.join(b, ["service", "_b"]).where(F.col("metric_at").between(F.col("at") - width, F.col("at") + width))
    return near.select("service", "log_id", "at", "message", "metric_id", "metric_at", "metric", "value")


def dropped_rows(query: StreamingQuery) -> int:
    """How many rows the query's watermarks have dropped in the batches that it still tells of."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
