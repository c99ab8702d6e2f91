"""The memo of answers: what a service that keeps its last answers would have answered from memory.

An answer is kept for a time to live, counted from when it was made (asking again doesn't prolong it); of more answers than the capacity, that which was used longest ago goes; answers that are not worth keeping are
made anew each time; a reload of the corpus empties the memo. Each instance of the service has a memo of its own, whose requests are one sequence by nature: instances are dealt to tasks, and a task holds no more than the capacity.

``replay`` is the batch form, over a log. ``remembered`` is the same over a stream: the memo is keyed state, and a timer takes out what has expired.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veinwork.functions.text import dense, fold
from veinwork.ship import ship

#: Answers kept, and for how long.
CAPACITY, TTL_SECONDS = 500, 30 * 60


def memo_key(question: Column) -> Column:
    """What questions with the same answer have in common; blank questions are never kept."""
    return dense(fold(question))


class Memo:
    """One instance's answers: key -> when it was made, the least recently used first. Times are in microseconds."""

    def __init__(self, ttl: int, capacity: int, entries: dict[str, int] | None = None):
        self.ttl, self.capacity = ttl, capacity
        self.entries: OrderedDict[str, int] = OrderedDict(entries or {})

    def ask(self, key: str | None, now: int, cacheable: bool, reload: bool) -> int | None:
        """When the answer was made, if it comes from the memo."""
        if reload:
            self.entries.clear()
            return None
        if not key:
            return None
        made = self.entries.get(key)
        if made is not None and now - made <= self.ttl:
            self.entries.move_to_end(key)
            return made
        self.entries.pop(key, None)
        if cacheable:
            self.entries[key] = now
            if len(self.entries) > self.capacity:
                self.entries.popitem(last=False)
        return None

    def expire(self, now: int) -> None:
        for key in [k for k, made in self.entries.items() if now - made > self.ttl]:
            del self.entries[key]


def replay(requests: DataFrame, ttl_seconds: int = TTL_SECONDS, capacity: int = CAPACITY) -> DataFrame:
    """(id, hit, made) for a log (instance, id, ts, key, cacheable, reload): whether each request was answered from memory, and when that answer was made.

    Requests of one time go by id. Null or blank keys are never kept; null flags are false; reloads are no hits. A null instance is an instance. Rows without a time come first.
    """
    kind, id_type = requests.schema["instance"].dataType.simpleString(), requests.schema["id"].dataType.simpleString()
    log = requests.select("instance", "id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("cacheable", F.lit(False)).alias("cacheable"), F.coalesce("reload", F.lit(False)).alias("reload"))
    ttl = ttl_seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, memo = object(), Memo(ttl, capacity)
        for batch in batches:
            made = []
            for instance, key, at, cacheable, reload in zip(*(batch.column(c).to_pylist() for c in ("instance", "key", "at", "cacheable", "reload"))):
                if instance != of:
                    of, memo = instance, Memo(ttl, capacity)
                made.append(memo.ask(key, at or 0, cacheable, reload))
            yield pa.RecordBatch.from_arrays([batch.column("instance"), batch.column("id"), pa.array([m is not None for m in made], pa.bool_()), pa.array(made, pa.int64())], names=["instance", "id", "hit", "made"])

    ship(requests.sparkSession)
    got = log.repartition("instance").sortWithinPartitions("instance", "at", "id").mapInArrow(run, f"instance {kind}, id {id_type}, hit boolean, made bigint")
    return got.withColumn("made", F.timestamp_micros("made"))


class _Remembered(StatefulProcessor):
    def __init__(self, ttl: int, capacity: int):
        self.ttl, self.capacity = ttl, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("answers", "key string", "made bigint, place int")

    def _load(self) -> Memo:
        rows = sorted(((v[1], k[0], v[0]) for k, v in self.kept.iterator()), key=lambda r: r[0])
        return Memo(self.ttl, self.capacity, {k: made for _, k, made in rows})

    def _save(self, memo: Memo) -> None:
        self.kept.clear()
        for place, (k, made) in enumerate(memo.entries.items()):
            self.kept.updateValue((k,), (made, place))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if memo.entries:
            self.handle.registerTimer((min(memo.entries.values()) + self.ttl) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        memo = self._load()
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            made = memo.ask(r["key"], r["at"], r["cacheable"], r["reload"])
            yield Row(instance=key[0], id=r["id"], hit=made is not None, made=made)
        self._save(memo)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        memo = self._load()
        memo.expire(timerValues.getCurrentWatermarkInMs() * 1000)
        self._save(memo)
        return iter(())

    def close(self) -> None:
        pass


def remembered(requests: DataFrame, ttl_seconds: int = TTL_SECONDS, capacity: int = CAPACITY, late: str = "10 minutes") -> DataFrame:
    """The rows of ``replay`` for a stream of requests, whose micro-batches come in the order of time. The session needs the RocksDB state store."""
    kind, id_type = requests.schema["instance"].dataType.simpleString(), requests.schema["id"].dataType.simpleString()
    log = requests.withWatermark("ts", late).select("instance", "id", "key", "ts", F.unix_micros("ts").alias("at"), F.coalesce("cacheable", F.lit(False)).alias("cacheable"), F.coalesce("reload", F.lit(False)).alias("reload"))
    ship(requests.sparkSession)
    got = log.groupBy("instance").transformWithState(_Remembered(ttl_seconds * 1_000_000, capacity), f"instance {kind}, id {id_type}, hit boolean, made bigint", "append", "EventTime")
    return got.withColumn("made", F.timestamp_micros("made"))
