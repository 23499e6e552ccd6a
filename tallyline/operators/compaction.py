"""Compaction: the latest event of each live task in the closed segments, with its payload, behind an atomic pointer."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.fold import latest, payloads
from tallyline.plans.views import ACKED, DEAD


def closed(log: DataFrame) -> DataFrame:
    """Events of all segments but the active (highest) one."""
    active = log.agg(F.max("segment_id").alias("__active"))
    return log.join(F.broadcast(active), F.col("segment_id") < F.col("__active")).drop("__active")  # one row


def survivors(events: DataFrame) -> DataFrame:
    """The latest event of each task, without ended tasks, with the payload; it keeps its place in the order."""
    s = latest(events, columns=("op", "priority", "retries", "consumer_id", "expire_ts", "segment_id")).where(~F.col("op").isin(ACKED, DEAD))
    return s.join(payloads(events), "id")


def stats(events: DataFrame) -> DataFrame:
    n = events.agg(F.countDistinct("segment_id").alias("segments_compacted"), F.count("*").alias("events_read"), F.max("id").alias("high_water"))
    return n.crossJoin(survivors(events).agg(F.count("*").alias("survivors")))  # one row by one row


def compacted(log: DataFrame) -> DataFrame:
    """The log after compaction: survivors of the closed segments, and the active segment as it is."""
    active = log.agg(F.max("segment_id").alias("__active"))
    rest = log.join(F.broadcast(active), F.col("segment_id") >= F.col("__active")).drop("__active")
    return survivors(closed(log)).unionByName(rest)


class Store:
    """A log as versioned Parquet folders and numbered pointer files, of which the last names the valid folders.

    A new version is written whole before a pointer names it. A pointer is made under a name that must not be there yet, so of
    two writers that start from one pointer the later has to start again from the other's: no append and no compaction is
    lost. The pointer also keeps the highest id ever given, for compaction may drop the rows that show it, and
    the folders that the last compaction replaced, which the next one removes: a reader keeps what it started with.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        root = self._path(self.path)
        return [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def _state(self) -> tuple[int, dict]:
        """The last pointer's number and content."""
        last = max((int(x[8:]) for x in self._names() if x.startswith("CURRENT-")), default=0)
        if not last:
            return 0, {"versions": [], "high_water": 0, "retired": []}
        return last, json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/CURRENT-{last:010d}").collect()))

    def _point(self, number: int, state: dict) -> bool:
        """Whether the pointer of this number could be made."""
        new, to = self._path(f"{self.path}/.pointer-{uuid.uuid4().hex}"), self._path(f"{self.path}/CURRENT-{number:010d}")
        out = self._fs.create(new, True)
        out.write(json.dumps(state).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(new, to, options)
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def append(self, events: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        events.write.parquet(f"{self.path}/{name}")
        top = self.spark.read.parquet(f"{self.path}/{name}").agg(F.max("id")).first()[0] or 0
        while True:
            number, state = self._state()
            if self._point(number + 1, state | {"versions": [*state["versions"], name], "high_water": max(state["high_water"], top)}):
                return

    def _read(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{v}" for v in state["versions"]])

    def is_empty(self) -> bool:
        return not self._state()[1]["versions"]

    def read(self) -> DataFrame:
        return self._read(self._state()[1])

    def high_water(self) -> int:
        return self._state()[1]["high_water"]

    def compact(self) -> bool:
        """Whether there was a closed segment to compact. Only the folders that were there at the start are rewritten; what
        is appended meanwhile follows them."""
        while True:
            start = self._state()[1]
            if not start["versions"]:
                return False
            log = self._read(start)
            if closed(log).isEmpty():
                return False
            name = f"v-{uuid.uuid4().hex}"
            compacted(log).write.parquet(f"{self.path}/{name}")
            while True:
                number, state = self._state()
                if not set(start["versions"]) <= set(state["versions"]):
                    self._fs.delete(self._path(f"{self.path}/{name}"), True)  # another compaction was first
                    break
                later = [v for v in state["versions"] if v not in start["versions"]]
                if self._point(number + 1, state | {"versions": [name, *later], "retired": start["versions"]}):
                    for old in state["retired"]:
                        self._fs.delete(self._path(f"{self.path}/{old}"), True)
                    return True

    def repair(self) -> list[str]:
        """Removes what a crash left: folders and pointers in the making that no pointer names. Only while no writer is at work."""
        number, state = self._state()
        named = {*state["versions"], *state["retired"], f"CURRENT-{number:010d}"}
        left = [x for x in self._names() if x not in named and x.startswith(("v-", ".pointer-", "CURRENT-"))]
        for x in left:
            self._fs.delete(self._path(f"{self.path}/{x}"), True)
        return left
