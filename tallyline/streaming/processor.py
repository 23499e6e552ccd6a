"""The live path: a queue's commands as a stream, folded by a stateful processor, with timers that end leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyline.plans.views import ACKED, CREATED, DEAD, EXPIRED, LEASED, MAX_FAILURES, NACKED

STATE = "op bigint, pos bigint, priority bigint, retries bigint, consumer_id bigint, expire_ts bigint"
OUT = "id bigint, op bigint, pos bigint, priority bigint, retries bigint"


class LatestEvent(StatefulProcessor):
    """Keeps the latest event of each task and sends the last change of each batch; a lease with an end in milliseconds can be
    given a timer. An expiry sent by a timer has the lease's place: whoever appends it to a log gives it a new one there."""

    def __init__(self, timers: bool = False):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        changed = False
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if best is None or r.pos > best[1]:
                    best, changed = (int(r.op), int(r.pos), int(r.priority), int(r.retries), int(r.consumer_id), int(r.expire_ts)), True
        if changed:
            self.state.update(best)
            if self.timers and best[0] == LEASED:
                self.handle.registerTimer(best[5])
            yield pd.DataFrame({"id": [key[0]], "op": [best[0]], "pos": [best[1]], "priority": [best[2]], "retries": [best[3]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        if best and best[0] == LEASED and best[5] <= expiredTimerInfo.getExpiryTimeInMs():
            retries = best[3] + 1
            op = DEAD if retries >= MAX_FAILURES else EXPIRED
            self.state.update((op, best[1], best[2], retries, best[4], best[5]))
            yield pd.DataFrame({"id": [key[0]], "op": [op], "pos": [best[1]], "priority": [best[2]], "retries": [retries]})

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_latest(events: DataFrame, path: str, checkpoint: str, timers: bool = False) -> DataFrame:
    """Runs a stream of events (id, pos, op, priority, retries, consumer_id, expire_ts) until it is empty; returns all changes sent."""
    spark = events.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        changes = events.groupBy("id").transformWithStateInPandas(LatestEvent(timers), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime" if timers else "None")
        q = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(OUT).parquet(path)


# ---- commands of a queue in their order: the batch form of the same machine ----

RESPONSES = "queue string, seq bigint, status bigint, error string, id bigint, priority bigint, retries bigint, payload binary"


NOTHING = (204, None, None, None, None, None)


class Machine:
    """One queue. Pops give the highest priority, then the oldest entry; a task given back goes behind its peers."""

    def __init__(self):
        self.next_id, self.order, self.ready, self.leased, self.data = 1, 0, {}, {}, {}
        self.ended, self.waiting = 0, []

    def _enqueue(self, id_: int, priority: int, retries: int) -> None:
        self.ready.setdefault(priority, {})[id_] = retries

    def expire(self, now: int) -> None:
        for id_ in sorted(i for i, x in self.leased.items() if now >= x[1]):
            self._fail(id_)

    def _fail(self, id_: int) -> None:
        _, _, priority, retries = self.leased.pop(id_)
        if retries + 1 >= MAX_FAILURES:
            self.data.pop(id_, None)
            self.ended += 1
        else:
            self._enqueue(id_, priority, retries + 1)

    def step(self, c) -> list[tuple]:
        """(seq, response) of a command and of the waiting pops that it, or the time, brings to an end."""
        wait, empty = getattr(c, "wait_secs", None), not any(self.ready.values())
        if c.cmd == "pop" and wait and empty and None not in (c.consumer_id, c.lease_secs, c.now_s):
            out = self._answers(c.now_s)
            self.waiting.append((int(c.now_s) + int(wait), c))
            return out
        return [(c.seq, self.apply(c)), *self._answers(c.now_s)]

    def _answers(self, now) -> list[tuple]:
        """Pops that waited: the first in line gets the next task; one whose time is over gets none."""
        out, still = [], []
        for until, c in self.waiting:
            if now is None or int(now) < until:
                got = self._pop(c, int(c.now_s if now is None else now)) if any(self.ready.values()) else None
                out += [(c.seq, got)] if got else []
                still += [] if got else [(until, c)]
            else:
                out.append((c.seq, NOTHING))
        self.waiting = still
        return out

    def close(self) -> list[tuple]:
        """No more commands: pops that still wait get nothing."""
        return [(c.seq, NOTHING) for _, c in self.waiting]

    def _pop(self, c, now: int) -> tuple:
        full = [p for p, x in self.ready.items() if x]
        if not full:
            return NOTHING
        p = max(full)
        id_ = next(iter(self.ready[p]))
        retries = self.ready[p].pop(id_)
        self.leased[id_] = (int(c.consumer_id), now + int(c.lease_secs), p, retries)
        return 200, None, id_, p, retries, self.data[id_]

    def apply(self, c) -> tuple:
        """status, error, id, priority, retries, payload. What a command needs and does not have is answered by 400."""
        needs = {"pop": ("consumer_id", "lease_secs", "now_s"), "ack": ("id", "consumer_id"), "nack": ("id", "consumer_id"), "tick": ("now_s",)}
        if any(getattr(c, name) is None for name in needs.get(c.cmd, ())):
            return 400, "bad_request", None, None, None, None
        if c.cmd in ("status", "compact") and self.next_id == 1:
            return 404, "not_found", None, None, None, None
        if c.cmd == "push":
            if c.payload is None or not 0 <= (c.priority or 0) <= 255:
                return 400, "bad_request", None, None, None, None
            id_, self.next_id = self.next_id, self.next_id + 1
            self.data[id_] = bytes(c.payload)
            self._enqueue(id_, int(c.priority or 0), 0)
            return 201, None, id_, int(c.priority or 0), 0, None
        if c.cmd == "pop":
            return self._pop(c, int(c.now_s))
        if c.cmd in ("ack", "nack"):
            id_ = int(c.id)
            if id_ not in self.leased:
                return 404, "not_found", id_, None, None, None
            if self.leased[id_][0] != int(c.consumer_id):
                return 409, "conflict", id_, None, None, None
            if c.cmd == "ack":
                del self.leased[id_]
                self.data.pop(id_, None)
                self.ended += 1
            else:
                self._fail(id_)
            return 200, None, id_, None, None, None
        if c.cmd == "tick":
            self.expire(int(c.now_s))
            return 200, None, None, None, None, None
        if c.cmd == "compact":
            gone, self.ended = self.ended, 0
            return 200, None, None, int(gone > 0), gone, None
        if c.cmd == "status":
            return 200, None, None, sum(map(len, self.ready.values())), len(self.leased), None
        return 400, "bad_request", None, None, None, None


def _responses(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["queue", "seq", "status", "error", "id", "priority", "retries", "payload"])
    return made.astype({c: "Int64" for c in ("id", "priority", "retries")})


def fold_commands(commands: DataFrame) -> DataFrame:
    """commands: queue, seq, now_s, cmd (push, pop, ack, nack, tick, status, compact), id, consumer_id, lease_secs, priority,
    payload and, where there is such a column, wait_secs.

    One response for each command; status answers with ready tasks as priority and leases as retries, compact with whether
    ended tasks were dropped and how many; both say 404 for a queue without a push. A pop with wait_secs that finds
    nothing is answered when a task gets ready before its time is over, by 204 else. Commands of a queue
    depend on each other, so a queue streams through one task in order, with the state of its live tasks; queues are parallel.
    """
    rows = commands.repartition("queue").sortWithinPartitions("queue", "seq")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, machine = None, None
        for pdf in frames:
            out = []
            for c in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                if machine is None or c.queue != name:
                    out += [(name, seq, *told) for seq, told in (machine.close() if machine else ())]
                    name, machine = c.queue, Machine()
                out += [(c.queue, seq, *told) for seq, told in machine.step(c)]
            yield _responses(out)
        if machine:
            yield _responses([(name, seq, *told) for seq, told in machine.close()])

    return rows.mapInPandas(work, RESPONSES)


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over Parquet files of a log."""
    return spark.readStream.schema("id bigint, pos bigint, op bigint, priority bigint, retries bigint, consumer_id bigint, expire_ts bigint").parquet(folder)


__all__ = ["ACKED", "CREATED", "NACKED", "LatestEvent", "Machine", "events_stream", "fold_commands", "stream_latest"]
