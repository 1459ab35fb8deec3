"""Caches with an age limit and a capacity, least recently used out first: as a fold and as a stream.

An operation is (cache, id, at, op, key, value). ``get`` hits if the key is there and at most
``ttl`` old, and makes it the last used; a key that is too old goes when it is asked for.
``put`` sets a value, which begins its age anew; a new key takes the place of the least
recently used one in a full cache. ``drop`` removes a key, ``drop_prefix`` all keys that begin
with the given one, ``look`` is a get that puts its value where it misses. Operations of one
cache go in order of ``at`` and ``id``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Entries and seconds of a cache of entity graphs (fixed values); of embeddings 10,000 and 86,400.
CAPACITY, TTL = 500, 3600.0
OPS = ("get", "put", "look", "drop", "drop_prefix")


class Cache:
    """The entries of one cache, least recently used first, and what changed since they were read."""

    def __init__(self, entries: dict[str, tuple[float, str | None]], capacity: int, ttl: float):
        self.entries: OrderedDict[str, tuple[float, str | None]] = OrderedDict(entries)
        self.capacity, self.ttl, self.gone, self.set = capacity, ttl, set(), set()

    def _remove(self, key: str) -> None:
        del self.entries[key]
        self.gone.add(key)
        self.set.discard(key)

    def _put(self, key: str, at: float, value: str | None) -> None:
        if key not in self.entries and len(self.entries) >= self.capacity:
            self._remove(next(iter(self.entries)))
        self.entries[key] = (at, value)
        self._touch(key)

    def _touch(self, key: str) -> None:
        self.entries.move_to_end(key)
        self.gone.discard(key)
        self.set.discard(key)
        self.set.add(key)

    def apply(self, at: float, op: str, key: str | None, value: str | None) -> tuple[bool | None, str | None]:
        """(hit, value) of the operation; hit is null for those that do not ask, and says for drops whether anything went."""
        if key is None or op not in OPS:
            return None, None
        if op in ("get", "look"):
            held = self.entries.get(key)
            if held is not None and at - held[0] <= self.ttl:
                self._touch(key)
                return True, held[1]
            if held is not None:
                self._remove(key)
            if op == "look":
                self._put(key, at, value)
            return False, value if op == "look" else None
        if op == "put":
            self._put(key, at, value)
            return None, value
        going = [k for k in self.entries if k.startswith(key)] if op == "drop_prefix" else [key] if key in self.entries else []
        for k in going:
            self._remove(k)
        return bool(going), None


def replay(ops: DataFrame, capacity: int = CAPACITY, ttl: float = TTL) -> DataFrame:
    """(cache, id, at, op, key, hit, value, size) for each operation, in batch; ``size`` is the cache's afterwards.

    Each cache is read as a sorted stream, so a worker holds the entries of one cache,
    ``capacity`` at most, and not its operations. Null times come first. Unknown operations
    and null keys change nothing; a null cache is one cache. Extra columns are dropped, and an
    empty table gives an empty one.
    """
    kinds = dict(ops.dtypes)
    rows = ops.select("cache", "id", F.col("at").cast("double").alias("at"), "op", "key", F.col("value").cast("string").alias("value"))
    dealt = rows.repartition("cache").sortWithinPartitions("cache", "at", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache = object(), Cache({}, capacity, ttl)
        for batch in batches:
            hits, values, sizes = [], [], []
            for name, at, op, key, value in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5))):
                if name != now:
                    now, cache = name, Cache({}, capacity, ttl)
                hit, found = cache.apply(at or 0.0, op, key, value)
                hits.append(hit)
                values.append(found)
                sizes.append(len(cache.entries))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(hits, pa.bool_()), pa.array(values, pa.string()), pa.array(sizes, pa.int64())], names=["cache", "id", "at", "op", "key", "hit", "value", "size"])

    return dealt.mapInArrow(fold, f"cache {kinds['cache']}, id {kinds['id']}, at double, op string, key string, hit boolean, value string, size long")


class CacheProcessor(StatefulProcessor):
    """One cache of a stream: its entries are map state, a counter of uses orders them.

    Entries are read once a batch and only those that changed are written back. With
    ``idle_ms`` a timer clears a cache that long without an operation, and the entries' own
    time to live in the state store is the same, so what is abandoned does not stay.
    """

    def __init__(self, capacity: int, ttl: float, idle_ms: int | None):
        self.capacity, self.ttl, self.idle_ms = capacity, ttl, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "at double, used long, value string", self.idle_ms)
        self.uses = handle.getValueState("uses", "n long", self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = sorted(((used, k[0], at, value) for k, (at, used, value) in self.entries.iterator()), key=lambda x: x[0])
        cache = Cache({k: (at, value) for _, k, at, value in held}, self.capacity, self.ttl)
        for r in sorted(rows, key=lambda r: (r["at"] is not None, r["at"] or 0.0, r["id"])):
            hit, value = cache.apply(r["at"] or 0.0, r["op"], r["key"], r["value"])
            yield Row(cache=key[0], id=r["id"], at=r["at"], op=r["op"], key=r["key"], hit=hit, value=value, size=len(cache.entries))
        used = (self.uses.get()[0] if self.uses.exists() else 0) + 1
        for k in cache.gone:
            self.entries.removeKey((k,))
        for k, (at, value) in cache.entries.items():  # in order of use
            if k in cache.set:
                self.entries.updateValue((k,), (at, used, value))
                used += 1
        self.uses.update((used,))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.entries.clear()
        self.uses.clear()
        return iter([])

    def close(self) -> None:
        pass


def cache_stream(ops: DataFrame, capacity: int = CAPACITY, ttl: float = TTL, idle_seconds: float | None = None) -> DataFrame:
    """The same as a stream, a cache a key; needs the RocksDB state store (``STORE``)."""
    kinds = dict(ops.dtypes)
    rows = ops.select("cache", "id", F.col("at").cast("double").alias("at"), "op", "key", F.col("value").cast("string").alias("value"))
    out = f"cache {kinds['cache']}, id {kinds['id']}, at double, op string, key string, hit boolean, value string, size long"
    idle = None if idle_seconds is None else int(idle_seconds * 1000)
    return rows.groupBy("cache").transformWithState(CacheProcessor(capacity, ttl, idle), out, "append", "none" if idle is None else "processingTime")


#: The setting that transformWithState needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stats(replayed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(cache, hits, misses, hit_rate, size, utilization_pct) from the rows of ``replay``: asked are gets and looks."""
    asked = F.col("op").isin("get", "look") & F.col("key").isNotNull()
    g = replayed.groupBy("cache").agg(F.count_if(asked & F.col("hit")).alias("hits"), F.count_if(asked & ~F.col("hit")).alias("misses"), F.max_by("size", F.struct("at", "id")).alias("size"))
    total = F.col("hits") + F.col("misses")
    return g.withColumns({"hit_rate": F.round(F.when(total > 0, F.col("hits") / total).otherwise(0.0), 4), "utilization_pct": F.round(F.col("size") / capacity * 100, 1)})
