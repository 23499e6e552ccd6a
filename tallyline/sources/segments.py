"""Segment files of binary frames: a scan through Spark's own readers, and a Python data source that also writes them.

`read_segments` takes whole segment files (64 MiB by default) from any store that Spark reads. The data source, format
"queue_segments", plans one partition for each segment and takes filters on segment_id before it opens a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tallyline.functions.codec import HEADER, MAGIC, MAX_PAYLOAD
from tallyline.operators.batching import rotate

SCHEMA = "segment_id bigint, offset bigint, id bigint, op bigint, priority bigint, payload binary"
SEGMENT_BYTES = 64 << 20


def frame(op: int, priority: int, id_: int, payload: bytes) -> bytes:
    if len(payload) > MAX_PAYLOAD:
        raise ValueError("payload over 64 MiB")
    body = struct.pack(">BBQI", op, priority, id_, len(payload)) + payload
    return struct.pack(">BI", MAGIC, crc32(body)) + body


def frames(data: bytes, policy: str = "skip") -> Iterator[tuple[int, int, int, int, bytes]]:
    """offset, id, op, priority, payload of the good frames of a segment.

    A frame whose bounds cannot be trusted (short, foreign, oversize) ends the segment. One with a wrong checksum or an
    unknown operation is passed over ("skip") or ends the segment too ("cut", as a writer does that truncates a damaged tail).
    """
    at = 0
    while at + HEADER <= len(data):
        magic, crc, op, priority, id_, size = struct.unpack_from(">BIBBQI", data, at)
        end = at + HEADER + size
        if magic != MAGIC or size > MAX_PAYLOAD or end > len(data):
            return
        if crc32(data[at + 5 : end]) == crc and op <= 5 and id_ < 1 << 63:
            yield at, id_, op, priority, bytes(data[at + HEADER : end])
        elif policy == "cut":
            return
        at = end


def segment_number(path: str) -> int:
    return int(path.rsplit("/", 1)[-1].split(".")[0])


def read_segments(spark: SparkSession, path: str, policy: str = "skip") -> DataFrame:
    """The good frames of all segments (files NNNNN.wal) of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path).select("path", "content")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(segment_number(p), *f) for f in frames(bytes(data), policy)]
                yield pd.DataFrame(rows, columns=["segment_id", "offset", "id", "op", "priority", "payload"])

    return files.mapInPandas(work, SCHEMA)


class _Segment(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Done(WriterCommitMessage):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class SegmentReader(DataSourceReader):
    def __init__(self, path: str, policy: str):
        self.path, self.policy, self.bounds = path, policy, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("segment_id",):
                self.bounds.append((type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, n: int) -> bool:
        test = {"EqualTo": n.__eq__, "GreaterThan": n.__gt__, "GreaterThanOrEqual": n.__ge__, "LessThan": n.__lt__, "LessThanOrEqual": n.__le__}
        return all(test[name](value) for name, value in self.bounds)

    def partitions(self):
        from pyarrow.fs import FileSelector

        store, path = _store(self.path)
        found = [f.path for f in store.get_file_info(FileSelector(path)) if f.path.endswith(".wal")]
        return [_Segment(p) for p in sorted(found, key=segment_number) if self._wanted(segment_number(p))]

    def read(self, partition):
        with _store(self.path)[0].open_input_stream(partition.path) as f:
            data = f.read()
        for offset, id_, op, priority, payload in frames(data, self.policy):
            yield segment_number(partition.path), offset, id_, op, priority, payload


class SegmentWriter(DataSourceWriter):
    """Each task writes the segments that its rows name, to temporary files that the commit renames.

    A segment is written once: appending refuses a number that is there already, overwriting replaces all segments.
    """

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        import uuid

        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        segment, out, temp, size = None, None, None, 0
        written = []
        for row in iterator:
            if row.segment_id != segment:
                if out:
                    out.close()
                    written.append((segment, temp))
                if any(s == row.segment_id for s, _ in written):
                    raise ValueError(f"the rows of segment {row.segment_id} do not come together")
                segment, temp = row.segment_id, f"{path}/.{uuid.uuid4().hex}.tmp"
                out = store.open_output_stream(temp)
            f = frame(row.op, row.priority, row.id, bytes(row.payload or b""))
            out.write(f)
            size += len(f)
        if out:
            out.close()
            written.append((segment, temp))
        return _Done(";".join(f"{s}={t}" for s, t in written), size)

    def commit(self, messages):
        from pyarrow.fs import FileSelector

        store, path = _store(self.path)
        new = [(int(s), t) for m in messages for s, t in (x.split("=", 1) for x in filter(None, m.path.split(";") if m else ()))]
        old = {segment_number(f.path): f.path for f in store.get_file_info(FileSelector(path, allow_not_found=True)) if f.path.endswith(".wal")}
        twice = {s for i, (s, _) in enumerate(new) if s in {x for x, _ in new[:i]} or s in old and not self.overwrite}
        if twice:
            self.abort(messages)
            raise FileExistsError(f"segments {sorted(twice)} of {path} are there already")
        for segment, temp in new:
            store.move(temp, f"{path}/{segment:05d}.wal")
        for segment, name in old.items():
            if self.overwrite and segment not in {s for s, _ in new}:
                store.delete_file(name)

    def abort(self, messages):
        store, _ = _store(self.path)
        for m in messages:
            for item in filter(None, m.path.split(";") if m else ()):
                store.delete_file(item.split("=", 1)[1])


class SegmentSource(DataSource):
    @classmethod
    def name(cls):
        return "queue_segments"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SegmentReader(self.options["path"], self.options.get("policy", "skip"))

    def writer(self, schema, overwrite):
        return SegmentWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format "queue_segments" known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentSource)


def write_segments(log: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes log (segment_id, offset, id, op, priority, payload); the rows of a segment come together, in order. Numbers of
    segments that are there already are refused; with overwrite all segments are replaced."""
    register(log.sparkSession)
    rows = log.select("segment_id", "offset", "id", "op", "priority", "payload").repartition("segment_id").sortWithinPartitions("segment_id", "offset")
    rows.write.format("queue_segments").mode("overwrite" if overwrite else "append").option("path", path).save()


def append_log(events: DataFrame, path: str, limit: int = SEGMENT_BYTES) -> DataFrame:
    """Appends events (seq, id, op, priority, payload) in the order of seq, in segments of `limit` bytes that follow those that
    are there; a closed file is never opened again. Returns seq, segment_id and offset of each event.

    Only sizes go through the one task that must see them in order; payloads join their places after.
    """
    from pyarrow.fs import FileSelector

    store, folder = _store(path)
    there = [segment_number(f.path) for f in store.get_file_info(FileSelector(folder, allow_not_found=True)) if f.path.endswith(".wal")]
    sizes = events.select(F.lit("").alias("queue"), "seq", (F.coalesce(F.octet_length("payload"), F.lit(0)) + HEADER).cast("bigint").alias("size"))
    places = rotate(sizes, limit).select("seq", (F.col("segment_id") + max(there, default=0)).alias("segment_id"), "offset")
    write_segments(events.join(places, "seq"), path)
    return places


def repair(path: str) -> list[str]:
    """Removes temporary files that no commit named. Only while no writer is at work."""
    from pyarrow.fs import FileSelector

    store, folder = _store(path)
    left = [f.path for f in store.get_file_info(FileSelector(folder, allow_not_found=True)) if f.path.endswith(".tmp")]
    for name in left:
        store.delete_file(name)
    return left
