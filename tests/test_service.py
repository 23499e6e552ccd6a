"""The HTTP service: a whole task's life over a socket, errors, long polls and the stop."""

from __future__ import annotations

import base64
import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from tallyline.operators.engine import Config, Engine, Queues
from tallyline.service import Service, options, server


@pytest.fixture
def service(spark, tmp_path):
    made = Service(Queues(spark, str(tmp_path / "q"), Config(segment_events=5)), sweep_secs=0.2)
    yield made
    made.shutdown()


def post(service, path, **body):
    return service.answer("POST", f"/v1/queues/{path}", json.dumps(body).encode())


def b64(data):
    return base64.b64encode(data).decode()


def test_life_over_a_socket(service):
    http = server(service, "127.0.0.1", 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def ask(path, body=None):
        url = f"http://127.0.0.1:{http.server_port}{path}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, None if body is None else json.dumps(body).encode()), timeout=60) as r:
                raw = r.read()
                return r.status, json.loads(raw) if raw.startswith(b"{") else raw.decode()
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())["error"]

    jobs = "/v1/queues/jobs"
    assert ask("/health") == (200, "OK") and ask("/v1/queues") == (200, {"queues": []})
    assert ask(f"{jobs}/status") == (404, "not_found") and ask(f"{jobs}/pop", {"consumer_id": 1, "lease_secs": 60}) == (204, "")
    assert ask(f"{jobs}/push?sync=true", {"payload": b64(b"low"), "priority": 1}) == (201, {"id": 1})
    assert ask(f"{jobs}/push", {"payload": b64(b"high"), "priority": 9}) == (201, {"id": 2})
    assert ask(f"{jobs}/pop", {"consumer_id": 1, "lease_secs": 60}) == (200, {"id": 2, "payload": b64(b"high"), "priority": 9, "retries": 0})
    assert ask(f"{jobs}/status") == (200, {"ready_tasks": 1, "active_leases": 1}) and ask("/v1/queues") == (200, {"queues": ["jobs"]})
    assert ask(f"{jobs}/tasks/2/ack", {"consumer_id": 5}) == (409, "conflict") and ask(f"{jobs}/tasks/7/ack", {"consumer_id": 1}) == (404, "not_found")
    assert ask(f"{jobs}/tasks/2/nack", {"consumer_id": 1}) == (200, "")
    assert ask(f"{jobs}/pop", {"consumer_id": 1, "lease_secs": 60})[1]["retries"] == 1
    assert ask(f"{jobs}/tasks/2/ack?sync=true", {"consumer_id": 1}) == (200, "")
    assert ask(f"{jobs}/compact", {}) == (200, {"compacted": True}) and ask("/v1/queues/none/compact", {}) == (404, "not_found")
    http.shutdown()
    http.server_close()


def test_faults(service):
    fine = {"payload": b64(b"x"), "priority": 0}
    for bad in ({"payload": "***"}, {"payload": None}, {"priority": 256}, {"priority": -1}, {"priority": True}, {"priority": None}):
        status, body = post(service, "jobs/push", **{**fine, **bad})
        assert (status, body["error"]) == (400, "bad_request"), bad
    for raw in (b"", b"[]", b"{", b"\xff"):
        assert service.answer("POST", "/v1/queues/jobs/pop", raw)[0] == 400
    assert post(service, "jobs/pop", consumer_id=1)[0] == 400 and post(service, "..%2Fout/push", **fine)[0] == 400
    assert service.answer("GET", "/v2")[0] == 404 and post(service, "jobs/tasks/x/ack", consumer_id=1)[0] == 404
    service.queues.get = lambda *a: 1 / 0
    assert post(service, "other/push", **fine)[1]["error"] == "internal_error"


def test_long_poll_expiry_and_stop(spark, service):
    got = []

    def wait(name, secs):
        t = threading.Thread(target=lambda: got.append(post(service, f"{name}/pop", consumer_id=3, lease_secs=1, wait_secs=secs)))
        t.start()
        return t

    waiting = wait("jobs", 60)
    time.sleep(1)
    assert post(service, "jobs/push", payload=b64(b"late"), priority=2)[0] == 201
    waiting.join(60)
    assert got.pop()[1]["payload"] == b64(b"late")
    # nobody answers: the sweep gives the task back to the next one that waits
    wait("jobs", 60).join(60)
    assert got.pop()[1]["retries"] == 1
    assert post(service, "empty/pop", consumer_id=1, lease_secs=1, wait_secs=1) == (204, None)
    assert post(service, "jobs/push", payload=b64(b"kept"), priority=0)[0] == 201
    waiting = wait("idle", 600)
    time.sleep(1)
    service.shutdown()
    waiting.join(60)
    assert got.pop()[0] == 503 and service.answer("GET", "/health")[0] == 503
    assert sum(Engine.open(spark, f"{service.queues.path}/jobs").status()) == 2


def test_options():
    o = options(["--port", "9", "--what", "ever", "--max-batch-size", "5"])
    assert (o.port, o.max_batch_size, o.data_dir) == (9, 5, "data")
