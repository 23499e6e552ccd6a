"""Queues over HTTP: JSON requests answered by `operators.engine.Queues`, long polls, the sweep of leases, and a command line.

A queue's requests are answered one after another, queues side by side. State is folded from the log, so a service that is
started anew on the same folder goes on where another stopped; one service writes to a folder at a time.
"""

from __future__ import annotations

import argparse
import base64
import binascii
import json
import re
import signal
import threading
import time
from collections.abc import Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from tallyline.operators.engine import Config, Engine, Queues

NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*")


class Fault(Exception):
    """An answer other than success: status, code, message."""


def _number(body: dict, name: str, most: int, default: int | None = None) -> int:
    value = body.get(name, default)
    if type(value) is not int or not 0 <= value <= most:
        raise Fault(400, "bad_request", f"{name} must be a number from 0 to {most}")
    return value


class Service:
    """Answers requests; `answer` needs no socket."""

    def __init__(self, queues: Queues, sweep_secs: float = 1.0):
        self.queues, self.sweep_secs = queues, sweep_secs
        self._guard, self._lines, self._stop = threading.Lock(), {}, threading.Event()
        self._sweeper = threading.Thread(target=self._sweep, daemon=True)
        self._sweeper.start()

    def _line(self, name: str, create: bool) -> tuple[Engine, threading.Condition] | None:
        if not NAME.fullmatch(name):
            raise Fault(400, "bad_request", "queue names have letters, digits, _, - and .")
        with self._guard:
            if name not in self._lines:
                engine = self.queues.get(name, create)
                if engine is None:
                    return None
                self._lines[name] = engine, threading.Condition()
            return self._lines[name]

    def _known(self, name: str) -> tuple[Engine, threading.Condition]:
        line = self._line(name, create=False)
        if line is None:
            raise Fault(404, "not_found", f"no queue {name}")
        return line

    def _sweep(self) -> None:
        while not self._stop.wait(self.sweep_secs):
            with self._guard:
                lines = list(self._lines.values())
            for engine, changed in lines:
                with changed:
                    if not self._stop.is_set() and engine.expire():
                        changed.notify_all()

    def answer(self, method: str, target: str, raw: bytes = b"") -> tuple[int, object]:
        """Status and body: JSON, text, or None for no body."""
        url = urlsplit(target)
        sync = parse_qs(url.query).get("sync", ["false"])[-1] == "true"
        try:
            if self._stop.is_set():
                raise Fault(503, "unavailable", "shutting down")
            match method, *map(unquote, url.path.strip("/").split("/")):
                case "GET", "health":
                    return 200, "OK"
                case "GET", "v1", "queues":
                    return 200, {"queues": self.queues.names()}
                case "GET", "v1", "queues", name, "status":
                    engine, changed = self._known(name)
                    with changed:
                        return 200, dict(zip(("ready_tasks", "active_leases"), engine.status(), strict=True))
                case "POST", "v1", "queues", name, "compact":
                    engine, changed = self._known(name)
                    with changed:
                        return 200, {"compacted": engine.compact()}
                case "POST", "v1", "queues", name, "push":
                    return self._push(name, self._body(raw), sync)
                case "POST", "v1", "queues", name, "pop":
                    return self._pop(name, self._body(raw))
                case "POST", "v1", "queues", name, "tasks", id_, "ack" | "nack" as verb if id_.isdecimal():
                    return self._end(name, int(id_), verb, self._body(raw))
            raise Fault(404, "not_found", "no such route")
        except Fault as e:
            status, error, message = e.args
        except Exception as e:  # whatever else fails must answer the request, not end the connection
            status, error, message = 500, "internal_error", str(e)
        return status, {"error": error, "message": message}

    @staticmethod
    def _body(raw: bytes) -> dict:
        try:
            body = json.loads(raw)
        except ValueError:
            body = None
        if not isinstance(body, dict):
            raise Fault(400, "bad_request", "the body must be a JSON object")
        return body

    def _push(self, name: str, body: dict, sync: bool) -> tuple[int, object]:
        priority = _number(body, "priority", 255)
        try:
            payload = base64.b64decode(body["payload"], validate=True)
        except (KeyError, TypeError, ValueError, binascii.Error):
            raise Fault(400, "bad_request", "payload must be base64") from None
        engine, changed = self._line(name, create=True)
        with changed:
            id_ = engine.push([(payload, priority)], sync=sync)[0]
            changed.notify()
        return 201, {"id": id_}

    def _pop(self, name: str, body: dict) -> tuple[int, object]:
        """With wait_secs a pop of an empty queue waits for a task until that time is over."""
        consumer, lease, wait = _number(body, "consumer_id", 2**32 - 1), _number(body, "lease_secs", 2**31), _number(body, "wait_secs", 2**31, 0)
        line = self._line(name, create=wait > 0)
        if line is None:
            return 204, None
        engine, changed = line
        until = time.monotonic() + wait
        with changed:
            while not (got := engine.pop(consumer, lease)):
                left = until - time.monotonic()
                if left <= 0:
                    return 204, None
                changed.wait(min(left, threading.TIMEOUT_MAX))
                if self._stop.is_set():
                    raise Fault(503, "unavailable", "shutting down")
        return 200, got[0] | {"payload": base64.b64encode(got[0]["payload"]).decode()}

    def _end(self, name: str, id_: int, verb: str, body: dict) -> tuple[int, object]:
        consumer = _number(body, "consumer_id", 2**32 - 1)
        engine, changed = self._known(name)
        with changed:
            result = getattr(engine, verb)([id_], consumer)[id_]
            changed.notify()
        if result != "ok":
            raise Fault(404 if result == "not_found" else 409, result, f"task {id_} is not leased" + (" to this consumer" if result == "conflict" else ""))
        return 200, None

    def shutdown(self) -> None:
        """Waiting pops are answered by 503, what waits is committed, and the queues take no more."""
        self._stop.set()
        self._sweeper.join()
        with self._guard:
            for engine, changed in self._lines.values():
                with changed:
                    changed.notify_all()
                    engine.shutdown()


def server(service: Service, host: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _serve(self) -> None:
            status, body = service.answer(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = b"" if body is None else body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            if data:
                self.send_header("Content-Type", "text/plain" if isinstance(body, str) else "application/json")
            if status != 204:
                self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _serve

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def options(argv: Sequence[str] | None = None) -> argparse.Namespace:
    """The command line; options that are not known are ignored."""
    p = argparse.ArgumentParser(prog="tallyline", description="Task queues over HTTP.")
    p.add_argument("--data-dir", default="data", help="folder or URL of the queues")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--max-batch-size", type=int, default=Config.most, help="pushes without sync that wait for one commit at most")
    p.add_argument("--segment-events", type=int, default=Config.segment_events, help="events of a segment")
    p.add_argument("--sweep-secs", type=float, default=1.0, help="time between sweeps of leases")
    return p.parse_known_args(argv)[0]


def main(argv: Sequence[str] | None = None) -> None:
    """Serves until SIGINT or SIGTERM."""
    o = options(argv)
    spark = SparkSession.builder.appName("tallyline").getOrCreate()
    service = Service(Queues(spark, o.data_dir, Config(o.max_batch_size, o.segment_events)), o.sweep_secs)
    http = server(service, o.host, o.port)
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: threading.Thread(target=http.shutdown).start())
    http.serve_forever()
    service.shutdown()
    http.server_close()
    spark.stop()
