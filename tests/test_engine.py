"""The engine: workers that drain a queue, failures, expiry, recovery and compaction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyline.operators.engine import Config, Engine, Queues


def test_worker_pool(spark, tmp_path):
    """Twelve tasks, three workers, one rejection; what is left after a reopening and a compaction."""
    queues = Queues(spark, str(tmp_path), Config(segment_events=5))
    assert queues.get("jobs", create=False) is None
    engine, woken = queues.get("jobs"), []
    engine.on_ready(woken.extend)
    ids = engine.push([(f"task {i}".encode(), {0: 3, 1: 1}.get(i % 3, 2)) for i in range(1, 13)])
    assert ids == list(range(1, 13)) == woken and engine.status() == (12, 0) and queues.names() == ["jobs"]
    order, worker = [], 0
    while engine.status()[0]:
        worker = worker % 3 + 1
        got = engine.pop(worker, 5, k=4, now=100)
        order += [(t["id"], t["retries"]) for t in got]
        assert all(t["payload"] == f"task {t['id']}".encode() for t in got)
        bad = [t["id"] for t in got if t["id"] == 4 and not t["retries"]]
        assert set(engine.ack([t["id"] for t in got if t["id"] not in bad], worker).values()) <= {"ok"}
        if bad:
            assert engine.nack([4], worker + 7) == {4: "conflict"} and engine.nack([4, 99], worker) == {4: "ok", 99: "not_found"}
    assert order == [(i, 0) for i in (3, 6, 9, 12, 2, 5, 8, 11, 1, 4, 7, 10)] + [(4, 1)] and woken[12:] == [4]
    assert engine.compact() and engine.status() == (0, 0)
    engine.shutdown()
    with pytest.raises(RuntimeError):
        engine.push([(b"x", 1)])
    assert Engine.open(spark, str(tmp_path / "jobs")).push([(b"next", 0)]) == [13]


def test_expiry_goes_behind_peers(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path), Config(most=3))
    engine.push([(b"a", 5)], sync=False)
    assert engine.commits == 0 and engine.push([(b"b", 5), (b"c", 9)], sync=False) == [2, 3] and engine.commits == 1
    assert [t["id"] for t in engine.pop(1, 10, k=2, now=0)] == [3, 1]
    assert engine.expire(9) == 0 and engine.expire(10) == 2 and engine.status() == (3, 0)
    assert [(t["id"], t["retries"]) for t in engine.pop(2, 10, k=3, now=20)] == [(3, 1), (2, 0), (1, 1)]
    table = spark.range(20).select(F.col("id").alias("at"), (F.col("id") % 3).alias("priority"), F.lit(b"t").alias("payload"))
    assert engine.push_table(table, "at") == 20 and engine.status() == (20, 3) and engine.push([(b"z", 255)]) == [24]
    with pytest.raises(ValueError):
        engine.push([(b"x", 256)])
