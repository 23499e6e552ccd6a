"""One queue behind one object: a store of its log, and the operations that read state from it and append events.

Operations are set-based: a pop leases k tasks, an acknowledgement answers any number of ids. State is never kept but folded
from the log, so an engine that is opened anew goes on where another stopped. One engine writes to a queue at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import fold, transitions
from tallyline.operators.compaction import Store
from tallyline.plans.views import ACKED, CREATED, EXPIRED, LEASED, NACKED

EVENT = "id bigint, op bigint, priority bigint, retries bigint, consumer_id bigint, expire_ts bigint, pos bigint, segment_id bigint, payload binary"


@dataclass(frozen=True)
class Config:
    """most: pushes that wait for one commit at most; segment_events: events of a segment."""

    most: int = 64
    segment_events: int = 1000


class Engine:
    """push, pop, ack, nack, expire, status, compact, sync; see `open`."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.config, self.store = spark, config, Store(spark, path)
        self.pending: list[tuple] = []
        self.commits, self.closed, self._ready = 0, False, None
        empty = self.store.is_empty()
        self._pos = 0 if empty else (self.store.read().agg(F.max("pos")).first()[0] or 0) + 1
        self._next = 1 if empty else self.store.high_water() + 1

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config = Config()) -> Engine:
        """Removes what a crash left, then recovers ids and places from the log. A lease whose end passed meanwhile is ended by the
        next expire."""
        Store(spark, path).repair()
        return cls(spark, path, config)

    def on_ready(self, callback: Callable[[list[int]], None] | None) -> None:
        """Called with the ids that a push, a rejection or an expiry made ready, after their commit."""
        self._ready = callback

    def _log(self) -> DataFrame:
        self.sync()
        return self.spark.createDataFrame([], EVENT) if self.store.is_empty() else self.store.read()

    def _append(self, rows: list[tuple]) -> None:
        """rows: id, op, priority, retries, consumer_id, expire_ts, payload, in their order."""
        if self.closed:
            raise RuntimeError("the engine is shut down")
        if rows:
            placed = [(*r[:6], self._pos + i, (self._pos + i) // self.config.segment_events, r[6]) for i, r in enumerate(rows)]
            self.store.append(self.spark.createDataFrame(placed, EVENT).coalesce(1))
            self._pos, self.commits = self._pos + len(rows), self.commits + 1

    def _tell(self, ids: list[int]) -> None:
        if ids and self._ready:
            self._ready(ids)

    def push(self, tasks: list[tuple[bytes, int]], sync: bool = True) -> list[int]:
        """tasks: payload and priority (0 to 255). Returns their ids. Without sync they wait for others, up to `most`."""
        if any(not 0 <= p <= 255 for _, p in tasks):
            raise ValueError("priority out of range")
        ids = list(range(self._next, self._next + len(tasks)))
        self._next += len(tasks)
        self.pending += [(i, CREATED, p, 0, None, None, data) for i, (data, p) in zip(ids, tasks, strict=True)]
        if sync or len(self.pending) >= self.config.most:
            self.sync()
        return ids

    def push_table(self, arrivals: DataFrame, order: str) -> int:
        """arrivals: payload, priority and a bigint column that orders them, of any size. Returns how many were pushed; the callback is not called."""
        self.sync()
        events = transitions.push(None, arrivals, self._next, order)
        place = F.col("id") - self._next + self._pos
        events = events.select("id", "op", "priority", F.lit(0).cast("bigint").alias("retries"), F.lit(None).cast("bigint").alias("consumer_id"), F.lit(None).cast("bigint").alias("expire_ts"), place.alias("pos"), F.floor(place / self.config.segment_events).alias("segment_id"), F.col("payload").cast("binary").alias("payload"))
        self.store.append(events)
        n = self.store.high_water() + 1 - self._next
        self._next, self._pos, self.commits = self._next + n, self._pos + n, self.commits + 1
        return n

    def sync(self) -> None:
        """The barrier: what was pushed before is durable after."""
        rows, self.pending = self.pending, []
        self._append(rows)
        self._tell([r[0] for r in rows])

    force_flush = sync

    def _state(self) -> DataFrame:
        return fold.latest(self._log())

    def pop(self, consumer: int, ttl: int, k: int = 1, now: int | None = None) -> list:
        """Leases the next k tasks: rows of id, payload, priority, retries."""
        log = self._log()
        end = (int(time.time()) if now is None else now) + ttl
        # a lease that is over counts once the sweep has ended it: no time is early enough to free it here
        won = fold.pop(fold.ready(log, -(2**62)), k)
        rows = won.collect()  # k rows
        if not rows:
            return []
        data = {r.id: r.payload for r in fold.payloads(log.where(F.col("id").isin([r.id for r in rows]))).collect()}
        self._append([(r.id, LEASED, r.priority, r.retries, consumer, end, None) for r in rows])
        return [{"id": r.id, "payload": bytes(data[r.id] or b""), "priority": r.priority, "retries": r.retries} for r in rows]

    def _answer(self, ids: list[int], consumer: int, op: int) -> dict[int, str]:
        held = self._state().where(F.col("op") == LEASED)
        asked = self.spark.createDataFrame([(i, consumer) for i in dict.fromkeys(ids)], "id bigint, consumer_id bigint")
        rows = transitions.validate(asked, held).join(held.select("id", "priority"), "id", "left").collect()  # one for each id asked
        good = sorted((r for r in rows if r.result == "ok"), key=lambda r: r.id)
        if op == ACKED:
            self._append([(r.id, ACKED, r.priority, r.retries, consumer, None, None) for r in good])
        else:
            self._fail([(r.id, r.priority, r.retries) for r in good], op)
        return {r.id: r.result for r in rows}

    def ack(self, ids: list[int], consumer: int) -> dict[int, str]:
        """ok, not_found or conflict for each id."""
        return self._answer(ids, consumer, ACKED)

    def nack(self, ids: list[int], consumer: int) -> dict[int, str]:
        return self._answer(ids, consumer, NACKED)

    def _fail(self, rows: list[tuple], op: int) -> None:
        """A failed task goes behind its peers, for its event has a new place; the third failure ends it."""
        if not rows:
            return
        after = transitions.failed(self.spark.createDataFrame(rows, "id bigint, priority bigint, retries bigint"), op).orderBy("id").collect()
        self._append([(r.id, r.op, r.priority, r.retries, None, None, None) for r in after])
        self._tell([r.id for r in after if r.requeued])

    def expire(self, now: int | None = None) -> int:
        """Ends leases whose time is over; returns how many."""
        over = self._state().where((F.col("op") == LEASED) & (F.col("expire_ts") <= (int(time.time()) if now is None else now)))
        rows = [(r.id, r.priority, r.retries) for r in over.select("id", "priority", "retries").toLocalIterator()]
        self._fail(rows, EXPIRED)
        return len(rows)

    def status(self) -> tuple[int, int]:
        """Ready and leased tasks."""
        ready, leased = self._state().agg(F.count_if(F.col("op").isin(CREATED, NACKED, EXPIRED)), F.count_if(F.col("op") == LEASED)).first()
        return ready, leased

    def compact(self) -> bool:
        self.sync()
        return self.store.compact()

    def shutdown(self) -> None:
        """Commits what waits and takes no more; a second call does nothing."""
        if not self.closed:
            self.sync()
            self.closed = True


class Queues:
    """Queues by name in one folder."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.path, self.config, self._open = spark, path.rstrip("/"), config, {}

    def names(self) -> list[str]:
        return sorted(Store(self.spark, self.path)._names())

    def get(self, name: str, create: bool = True) -> Engine | None:
        """The queue, made if it is not there; with create=False None for an unknown one."""
        if name not in self._open:
            if not create and name not in self.names():
                return None
            self._open[name] = Engine.open(self.spark, f"{self.path}/{name}", self.config)
        return self._open[name]

    def shutdown(self) -> None:
        for engine in self._open.values():
            engine.shutdown()
