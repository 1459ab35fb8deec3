"""State by key: the exact rate limit, caches with age and size, and tiered memory.

Streams keep state in ``applyInPandasWithState``; the batch forms are folds over sorted
streams of rows, or windows where the rule allows it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admitted(times: list[float], kept: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which calls pass when rejected ones are not recorded, and the recorded times afterwards."""
    passed = []
    for t in times:
        kept = [k for k in kept if t - k < seconds]
        passed.append(len(kept) < most)
        if passed[-1]:
            kept.append(t)
    return passed, kept


def rate_limit(calls: DataFrame, most: int = 100, seconds: int = 60) -> DataFrame:
    """(client, id, at, allowed) for calls (client, id, at double): a client's calls are folded in order.

    After a gap of ``seconds`` nothing is recorded, so stretches between gaps are dealt out
    apart. Each is read as a sorted stream that keeps its last ``most`` admitted times only.
    """
    w = Window.partitionBy("client").orderBy(F.asc_nulls_last("at"), "id")
    gap = F.coalesce(F.col("at") - F.lag("at").over(w) >= seconds, F.lit(True))
    begun = calls.select("client", "id", F.col("at").cast("double").alias("at")).withColumn("begins", gap)
    dealt = begun.withColumn("stretch", F.sum(F.col("begins").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).repartition("client", "stretch")
    rows = dealt.sortWithinPartitions("client", "stretch", F.desc("begins"), F.asc_nulls_last("at"), "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: deque[float] = deque()
        for batch in batches:
            passed = []
            for t, begins in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if begins:
                    kept.clear()
                while kept and t - kept[0] >= seconds:
                    kept.popleft()
                passed.append(len(kept) < most)
                if passed[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(passed, pa.bool_())], names=["client", "id", "at", "allowed"])

    kinds = dict(calls.dtypes)
    return rows.select("client", "id", "at", "begins").mapInArrow(fold, f"client {kinds['client']}, id {kinds['id']}, at double, allowed boolean")


def rate_limit_stream(calls: DataFrame, most: int = 100, seconds: int = 60, forget: bool = True) -> DataFrame:
    """The same as a stream: each client's recorded times are its state.

    With ``forget``, clients that are idle for ``seconds`` lose their state. Spark then runs
    batches for ever, to see who is idle, so a query that should end (``availableNow``) needs
    ``forget=False``.
    """
    kinds = dict(calls.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        whole = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        passed, kept = admitted(whole["at"].tolist(), kept, most, seconds)
        state.update((kept,))
        if forget:
            state.setTimeoutDuration(seconds * 1000)
        yield whole.assign(allowed=passed)[["client", "id", "at", "allowed"]]

    out = f"client {kinds['client']}, id {kinds['id']}, at double, allowed boolean"
    return calls.select("client", "id", "at").groupBy("client").applyInPandasWithState(step, out, "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def live_entries(entries: DataFrame, now: float, key: str = "key", capacity: int = 500, ttl: float = 3600.0) -> DataFrame:
    """Cache entries (key, at, used) that are young enough, the most recently used ``capacity`` of them: a top-k."""
    latest = entries.groupBy(key).agg(F.max_by(F.struct(*[c for c in entries.columns if c != key]), "at").alias("_e")).select(key, "_e.*")
    return latest.where(F.lit(now) - F.col("at") <= ttl).orderBy(F.desc("used"), key).limit(capacity)


def remember(tiers: list[DataFrame], text: str) -> DataFrame:
    """Entries (key, value) that hold the text, from the first tier that has the key; adds ``tier``."""
    parts = [t.select("key", "value", F.lit(k).alias("tier")) for k, t in enumerate(tiers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = Window.partitionBy("key").orderBy("tier")
    hit = out.where(F.contains(F.lower("value"), F.lit(text.lower())))
    return hit.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
