"""The queue: SQL parity of all queries, the frame codec and segments under damage, transitions, compaction, the machine."""

from __future__ import annotations

import random
import struct
from zlib import crc32

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyline.functions import codec
from tallyline.operators import batching, compaction, fold, transitions
from tallyline.plans import http, registry
from tallyline.plans.views import ACKED, CREATED, EXPIRED, LEASED, NACKED, position
from tallyline.sources import segments
from tallyline.streaming import processor

DIR = "/root/testdata/sf0.001"
LOG = "id bigint, op bigint, priority bigint, retries bigint, consumer_id bigint, expire_ts bigint, pos bigint, segment_id bigint, payload string"


def log(spark, events):
    """events: (id, op, extra) with a running position; ten to a segment."""
    rows = [(e[0], e[1], e[2] if len(e) > 2 else 5, e[3] if len(e) > 3 else 0, 1, e[4] if len(e) > 4 else 100, i, i // 10, e[5] if len(e) > 5 else f"p{e[0]}") for i, e in enumerate(events)]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in "customer orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in registry.SQL:
        assert rows
        return
    rel = con.execute(registry.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in rows)


# ---- order ----


def test_priority_then_fifo(spark):
    tasks = log(spark, [(i + 1, CREATED, p) for i, p in enumerate([10, 255, 0, 128, 50, 255, 0, 128])])
    ready = fold.ready(tasks, 0)
    assert [r.priority for r in fold.pop(ready, 8).collect()] == [255, 255, 128, 128, 50, 10, 0, 0]
    ranked = fold.dispatch_rank(ready, block=2).orderBy("dispatch_rank").collect()
    assert [r.dispatch_rank for r in ranked] == list(range(1, 9)) and [r.id for r in ranked] == [2, 6, 4, 8, 5, 1, 3, 7]


def test_requeued_goes_to_the_back(spark):
    ready = fold.ready(log(spark, [(1, CREATED), (2, CREATED), (1, LEASED), (1, NACKED, 5, 1)]), 0)
    assert [(r.id, r.retries) for r in fold.pop(ready, 2).collect()] == [(2, 0), (1, 1)]


def test_expired_lease_is_ready(spark):
    events = [(1, CREATED), (1, LEASED, 5, 2, 50)]
    assert fold.ready(log(spark, events), 50).collect()[0].retries == 2
    assert fold.ready(log(spark, events), 49).count() == 0 and fold.leases(log(spark, events), 49).count() == 1


def test_position_order(spark):
    df = spark.createDataFrame([(2, 0), (1, 5), (1, 70_000_000_000 % (1 << 36))], "s bigint, o bigint")
    got = [tuple(r) for r in df.orderBy(position(F.col("s"), F.col("o"))).collect()]
    assert got == sorted(got)


# ---- transitions ----


def test_validation(spark):
    leases = spark.createDataFrame([(1, 7, 0), (2, 8, 2)], "id bigint, consumer_id bigint, retries bigint")
    asked = spark.createDataFrame([(1, 7), (1, 99), (999, 7), (2, 8)], "id bigint, consumer_id bigint")
    got = {(r.id, r.consumer_id): r.result for r in transitions.validate(asked, leases).collect()}
    assert got == {(1, 7): "ok", (1, 99): "conflict", (999, 7): "not_found", (2, 8): "ok"}


def test_third_failure_ends(spark):
    leases = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id bigint, retries bigint")
    assert [(r.retries, r.op, r.requeued) for r in transitions.failed(leases, NACKED).orderBy("id").collect()] == [(1, 3, True), (2, 3, True), (3, 5, False)]


# ---- compaction ----


def test_compaction_keeps_payload_and_order(spark, tmp_path):
    events = [(1, CREATED), (1, LEASED), (1, ACKED), (2, CREATED), (3, CREATED), (4, CREATED), (3, LEASED, 5, 0, 9), (3, NACKED, 5, 1), (9, CREATED), (9, LEASED), (9, ACKED), (4, LEASED, 5, 0, 99)]
    store = compaction.Store(spark, str(tmp_path))
    assert not (store.append(log(spark, events[:5])) or store.compact())
    store = compaction.Store(spark, str(tmp_path / "b"))
    whole = log(spark, events)
    store.append(whole)
    before = {(r.id, r.priority, r.retries, r.pos) for r in fold.ready(whole, 0).collect()}
    assert store.compact()
    after = store.read()
    assert {(r.id, r.priority, r.retries, r.pos) for r in fold.ready(after, 0).collect()} == before
    assert {r.id: r.payload for r in fold.payloads(after).collect()} == {2: "p2", 3: "p3", 4: "p4"}
    assert fold.next_id(after, store.high_water()).first()[0] == 10 and after.where("id = 1").count() == 0


def test_payload_after_an_end_is_the_new_one(spark):
    events = [(1, CREATED, 5, 0, 0, "old"), (1, ACKED), (1, CREATED, 5, 0, 0, "new"), (2, LEASED, 5, 0, 0, "carried"), (2, NACKED, 5, 1, 0, "later")]
    assert {r.id: r.payload for r in fold.payloads(log(spark, events)).collect()} == {1: "new", 2: "carried"}


def test_append_during_compaction(spark, tmp_path, monkeypatch):
    """What comes in while the closed segments are rewritten stays, and an end that comes then is not undone."""
    store = compaction.Store(spark, str(tmp_path))
    store.append(log(spark, [(i % 3 + 1, CREATED) for i in range(12)]))
    late = log(spark, [(7, CREATED), (1, ACKED)]).withColumns({"pos": F.col("pos") + 100, "segment_id": F.col("segment_id") + 10})
    real = compaction.compacted

    def meanwhile(events):
        monkeypatch.setattr(compaction, "compacted", real)
        store.append(late)
        return real(events)

    monkeypatch.setattr(compaction, "compacted", meanwhile)
    assert store.compact()
    assert sorted(r.id for r in fold.ready(store.read(), 0).collect()) == [2, 3, 7] and store.high_water() == 7
    number, state = store._state()
    assert not store._point(number, state)  # a pointer is made once
    (tmp_path / "v-left").mkdir()
    assert "v-left" in store.repair() and store.compact() and sorted(r.id for r in fold.ready(store.read(), 0).collect()) == [2, 3, 7]


def test_two_compactions(spark, tmp_path, monkeypatch):
    """Of two compactions at once the later starts again from the other's result."""
    one, two = (compaction.Store(spark, str(tmp_path)) for _ in range(2))
    one.append(log(spark, [(i % 4 + 1, CREATED) for i in range(15)]))
    real = compaction.compacted

    def meanwhile(events):
        monkeypatch.setattr(compaction, "compacted", real)
        assert two.compact()
        return real(events)

    monkeypatch.setattr(compaction, "compacted", meanwhile)
    one.compact()
    assert sorted(r.id for r in fold.ready(one.read(), 0).collect()) == [1, 2, 3, 4]


def test_push_numbers_without_gaps(spark):
    arrivals = spark.createDataFrame([(i * i * 1000, i % 5, b"x") for i in range(50)], "seq bigint, priority bigint, payload binary")
    got = transitions.push(None, arrivals, 7, "seq", keep=("seq", "payload"), blocks=6).orderBy("seq").collect()
    assert [r.id for r in got] == list(range(7, 57)) and transitions.push(None, arrivals.limit(0), 1, "seq").count() == 0


# ---- frames ----


def test_frame_bytes(spark):
    rows = [(0, 7, 1, b""), (5, 255, 1 << 40, b"payload"), (1, 0, 2**63 - 1, bytes(range(256)) * 20)]
    df = spark.createDataFrame(rows, "op bigint, priority bigint, id bigint, payload binary")
    for r in df.select("*", codec.encode(*map(F.col, ("op", "priority", "id", "payload"))).alias("f")).collect():
        body = struct.pack(">BBQI", r.op, r.priority, r.id, len(r.payload)) + bytes(r.payload)
        assert bytes(r.f) == b"\x4e" + struct.pack(">I", crc32(body)) + body == segments.frame(r.op, r.priority, r.id, bytes(r.payload))


def test_every_bit_flip_and_cut(spark):
    good = segments.frame(1, 9, 42, b"x" * 50)
    bad = [bytes(b ^ (1 << (i % 8)) if j == i // 8 else b for j, b in enumerate(good)) for i in range(8 * len(good))]
    bad += [good[:n] for n in range(len(good))] + [good + b"!", segments.frame(1, 9, 42, b"")[:15] + b"\xff\xff\xff\xff", b""]
    unknown = struct.pack(">BBQI", 6, 0, 1, 0)
    bad.append(b"\x4e" + struct.pack(">I", crc32(unknown)) + unknown)
    df = spark.createDataFrame([(x,) for x in bad], "f binary")
    assert df.where(codec.decode(F.col("f")).isNotNull()).count() == 0
    assert spark.createDataFrame([(good,)], "f binary").select(codec.decode(F.col("f")).alias("r")).first().r.id == 42


def test_damaged_segments(spark, tmp_path):
    f = [segments.frame(0, 1, i, b"data") for i in range(11)]
    broken = bytearray(f[4])
    broken[-1] ^= 1
    (tmp_path / "00001.wal").write_bytes(f[1] + f[2] + b"\x00" + f[3])  # a foreign byte ends the segment
    (tmp_path / "00002.wal").write_bytes(f[3] + bytes(broken) + f[5])  # a wrong checksum costs one frame
    (tmp_path / "00010.wal").write_bytes(f[6] + f[7][:-2])  # a torn tail
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(segments.read_segments(spark, str(tmp_path))) == [1, 2, 3, 5, 6]
    assert ids(segments.read_segments(spark, str(tmp_path), "cut")) == [1, 2, 3, 6]
    segments.register(spark)
    source = spark.read.format("queue_segments").option("path", str(tmp_path)).load()
    assert ids(source) == [1, 2, 3, 5, 6] and ids(source.where("segment_id >= 2 and segment_id < 10")) == [3, 5]


def test_written_segments(spark, tmp_path):
    rows = spark.range(100).selectExpr("id div 10 as segment_id", "id as offset", "id", "0L as op", "id % 256 as priority", "cast(cast(id as string) as binary) as payload")
    segments.write_segments(rows, str(tmp_path / "s"))
    got = segments.read_segments(spark, str(tmp_path / "s"))
    assert got.count() == 100 and got.groupBy("segment_id").count().where("count = 10").count() == 10


def test_segments_are_written_once(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda ids, segment: spark.createDataFrame([(segment, i, i, 0, 0, b"x") for i in ids], segments.SCHEMA)
    segments.write_segments(rows([1, 2], 1), path)
    with pytest.raises(Exception, match="there already"):
        segments.write_segments(rows([3], 1), path)
    ids = lambda: sorted(r.id for r in segments.read_segments(spark, path).collect())
    assert ids() == [1, 2]
    events = spark.createDataFrame([(i, i, 0, 0, b"y" * 81) for i in range(3, 13)], "seq bigint, id bigint, op bigint, priority bigint, payload binary")
    assert {r.segment_id for r in segments.append_log(events, path, 250).collect()} == {2, 3, 4, 5} and ids() == list(range(1, 13))
    (tmp_path / "s" / ".left.tmp").write_bytes(b"")
    assert len(segments.repair(path)) == 1
    segments.write_segments(rows([99], 2), path, overwrite=True)
    assert ids() == [99]


# ---- batches, bodies ----


def test_rotation_limit(spark):
    sizes = spark.createDataFrame([("q", i, 109) for i in range(5)] + [("r", 0, 300), ("r", 1, 20)], "queue string, seq bigint, size bigint")
    got = {(r.queue, r.seq): (r.segment_id, r.offset) for r in batching.rotate(sizes, 100).collect()}
    assert [got["q", i] for i in range(5)] == [(i + 1, 0) for i in range(5)] and got["r", 1] == (2, 0)


def test_batches(spark):
    a = spark.createDataFrame([("q", t, i) for i, t in enumerate([0, 5, 9, 30, 31, 60])], "queue string, at bigint, seq bigint")
    batch = lambda df: [r.batch for r in df.orderBy("seq").collect()]
    assert batch(batching.idle_batches(a, 21)) == [0, 0, 0, 1, 1, 2]
    assert batch(batching.capped_batches(a, 10**6, 2)) == [0, 0, 1, 1, 2, 2]
    assert batch(batching.capped_batches(a, 10, 100)) == [0, 0, 0, 1, 1, 2]
    assert batch(batching.capped_batches(a, 10**6, 100, 29)) == [0, 0, 0, 0, 0, 1]


def test_bodies(spark):
    df = spark.createDataFrame([('{"payload":"aGk=","priority":3}',), ('{"payload":"*"}',)], "body string").select(http.parse_push(F.col("body")).alias("r"))
    assert [(r.r.payload and bytes(r.r.payload), r.r.priority) for r in df.collect()] == [(b"hi", 3), (None, 0)]
    high = spark.createDataFrame([('{"payload":"aGk=","priority":300}',), ('{"payload":"aGk=","priority":255}',)], "body string").select(http.parse_push(F.col("body")).alias("r"))
    assert [(r.r.priority, r.r.status) for r in high.collect()] == [(None, 400), (255, 201)]
    one = spark.range(1).select(http.pop_response(F.lit(1), F.lit(b"hi"), F.lit(2), F.lit(0)).alias("a"), http.error_response(F.lit("conflict"), F.lit("m")).alias("b")).first()
    assert one.a == '{"id":1,"payload":"aGk=","priority":2,"retries":0}' and one.b == '{"error":"conflict","message":"m"}'


# ---- the machine ----

COMMANDS = "queue string, seq bigint, now_s bigint, cmd string, id bigint, consumer_id bigint, lease_secs bigint, priority bigint, payload binary"


def run(spark, commands):
    rows = [(c.get("queue", "q"), i, c.get("now", 0), c["cmd"], c.get("id"), c.get("by", 1), c.get("ttl", 10), c.get("p", 0), c.get("data", b"d") if c["cmd"] == "push" else None) for i, c in enumerate(commands)]
    return processor.fold_commands(spark.createDataFrame(rows, COMMANDS)).orderBy("seq").collect()


def test_lifecycle(spark):
    pop, push = {"cmd": "pop"}, {"cmd": "push", "p": 5}
    out = run(spark, [pop, push, pop, {"cmd": "ack", "id": 1, "by": 99}, {"cmd": "ack", "id": 1}, {"cmd": "ack", "id": 1}, {"cmd": "status"}])
    assert [r.status for r in out] == [204, 201, 200, 409, 200, 404, 200] and bytes(out[2].payload) == b"d" and (out[6].priority, out[6].retries) == (0, 0)


def test_three_rejections(spark):
    out = run(spark, [{"cmd": "push"}, *[{"cmd": c, "id": 1} for _ in range(3) for c in ("pop", "nack")], {"cmd": "pop"}])
    assert [r.retries for r in out if r.seq in (1, 3, 5)] == [0, 1, 2] and out[-1].status == 204


def test_expiry_and_late_answers(spark):
    out = run(spark, [{"cmd": "push"}, {"cmd": "pop", "ttl": 1}, {"cmd": "tick", "now": 1}, {"cmd": "pop", "by": 2, "now": 2}, {"cmd": "ack", "id": 1}, {"cmd": "nack", "id": 1}, {"cmd": "ack", "id": 1, "by": 2}])
    assert [r.status for r in out] == [201, 200, 200, 200, 409, 409, 200] and out[3].retries == 1


def test_missing_values(spark):
    """What is missing is answered by 400, and a queue without a push by 404."""
    rows = [("q", 0, 0, "status", None, None, None, None, None), ("q", 1, 0, "push", None, None, None, 300, b"x"), ("q", 2, 0, "push", None, None, None, None, b"x"), ("q", 3, 0, "pop", None, None, 5, None, None), ("q", 4, None, "pop", None, 1, 5, None, None), ("q", 5, 0, "ack", None, 1, None, None, None), ("q", 6, None, "tick", None, None, None, None, None), ("q", 7, 0, "compact", None, None, None, None, None)]
    assert [r.status for r in processor.fold_commands(spark.createDataFrame(rows, COMMANDS)).orderBy("seq").collect()] == [404, 400, 201, 400, 400, 400, 400, 200]


def test_waiting_pops(spark):
    """A pop waits for a push or a rejection, in line with others, or till its time is over."""
    rows = [(0, 0, "pop", 1, 9), (1, 0, "pop", 2, 9), (2, 1, "push", None, None), (3, 2, "nack", 1, None), (4, 30, "pop", 3, 5), (5, 40, "push", None, None), (6, 40, "pop", 4, 5), (7, 41, "pop", 5, 5)]
    df = spark.createDataFrame([("q", s, now, cmd, 1, who, 10, 0, b"d", wait) for s, now, cmd, who, wait in rows], COMMANDS + ", wait_secs bigint")
    out = {r.seq: (r.status, r.id, r.retries) for r in processor.fold_commands(df).collect()}
    assert out[0] == (200, 1, 0) and out[1] == (200, 1, 1) and out[4] == (204, None, None) and out[6] == (200, 2, 0) and out[7][0] == 204 and len(out) == 8


class Plain:
    """A queue as a list that is searched from the start."""

    def __init__(self):
        self.tasks, self.count, self.clock = [], 0, 0

    def apply(self, c):
        self.clock += 1
        held = next((t for t in self.tasks if t["id"] == c.id and t["by"] is not None), None)
        if c.cmd == "push":
            self.count += 1
            self.tasks.append({"id": self.count, "p": c.priority, "at": self.clock, "n": 0, "by": None, "end": None})
            return 201, self.count
        if c.cmd == "pop":
            free = sorted((t for t in self.tasks if t["by"] is None), key=lambda t: (-t["p"], t["at"]))
            if free:
                free[0].update(by=c.consumer_id, end=c.now_s + c.lease_secs)
            return (200, free[0]["id"]) if free else (204, None)
        if c.cmd == "tick":
            for t in sorted((t for t in self.tasks if t["by"] is not None and c.now_s >= t["end"]), key=lambda t: t["id"]):
                self.fail(t)
            return 200, None
        if held is None or held["by"] != c.consumer_id:
            return (404 if held is None else 409), c.id
        if c.cmd == "ack":
            self.tasks.remove(held)
        else:
            self.fail(held)
        return 200, c.id

    def fail(self, t):
        self.clock += 1
        t.update(by=None, n=t["n"] + 1, at=self.clock)
        if t["n"] == 3:
            self.tasks.remove(t)


def test_command_fold_whole_table(spark, monkeypatch):
    """The query's commands over a whole table, against the list."""
    kept, real = [], processor.fold_commands
    monkeypatch.setattr(processor, "fold_commands", lambda c: kept.append(c) or real(c))
    got = {(r.queue, r.seq): (r.status, r.id) for r in registry.command_fold(spark, "/root/testdata/sf0.01").collect()}
    queues, want = {}, {}
    for c in sorted(kept[0].collect(), key=lambda c: c.seq):
        want[c.queue, c.seq] = queues.setdefault(c.queue, Plain()).apply(c)
    assert got == want


def test_queues_are_apart(spark):
    out = run(spark, [{"cmd": "push", "queue": q} for q in "ab" for _ in range(3)])
    assert [(r.queue, r.id) for r in out] == [(q, i) for q in "ab" for i in (1, 2, 3)]


def test_machine_against_linear_scan():
    """Random operations against a list that is searched from the start."""
    rng, m, tasks, order, n = random.Random(11), processor.Machine(), {}, 0, 0
    for _ in range(20_000):
        kind = rng.choice(["push", "pop", "pop", "ack", "nack"])
        c = type("C", (), {"cmd": kind, "payload": b"x", "priority": rng.randrange(4), "consumer_id": 1, "lease_secs": 10, "now_s": 0, "id": rng.randrange(1, n + 2)})
        status, _, id_, *_ = m.apply(c)
        order += 1
        if kind == "push":
            n += 1
            tasks[n] = ["ready", c.priority, order, 0]
            assert id_ == n
        elif kind == "pop":
            best = min((i for i, t in tasks.items() if t[0] == "ready"), key=lambda i: (-tasks[i][1], tasks[i][2]), default=None)
            assert id_ == best and status == (200 if best else 204)
            if best:
                tasks[best][0] = "leased"
        else:
            held = tasks.get(c.id, ["none"])[0] == "leased"
            assert status == (200 if held else 404)
            if held and kind == "ack":
                del tasks[c.id]
            elif held:
                tasks[c.id][3] += 1
                tasks[c.id][0:3:2] = ["ready", order]
                if tasks[c.id][3] == 3:
                    del tasks[c.id]


class Handle:
    """A state handle that remembers."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)


def test_timers():
    """A lease whose end has passed counts as a failure; the third ends the task; an answered lease's timer does nothing."""
    for retries, op in ((0, EXPIRED), (2, 5)):
        h, p = Handle(), processor.LatestEvent(timers=True)
        p.init(h)
        rows = pd.DataFrame({"id": [1, 1], "pos": [0, 1], "op": [CREATED, LEASED], "priority": 5, "retries": retries, "consumer_id": 1, "expire_ts": [0, 1000]})
        assert list(p.handleInputRows((1,), iter([rows]), None))[0]["op"].tolist() == [LEASED] and h.timers == [1000]
        fired = type("T", (), {"getExpiryTimeInMs": lambda self: 1000})()
        assert list(p.handleExpiredTimer((1,), None, fired))[0][["op", "retries"]].values.tolist() == [[op, retries + 1]]
        assert list(p.handleExpiredTimer((1,), None, fired)) == []
