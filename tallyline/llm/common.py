"""What the operators of this subpackage share: the shared folder, written tables, text bytes, vectorised word hashes."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
#: Stands for a null doc_id inside Python code; such documents sort before all others.
NULL_ID = -(2**63)
#: A key is hot if it holds over one in HOT_SHARE of the rows (and over HOT_LEAST), so at most HOT_SHARE keys are; the rows
#: of a hot key are spread over SPREAD tasks.
HOT_SHARE, HOT_LEAST, SPREAD = 2000, 1000, 32
#: A table that is brought to the driver partition by partition has at most so many, each of which is a job there.
FETCHES = 48
#: Rows of a table that is broadcast after they were counted.
SMALL = 2_000_000


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this package on the executors' path."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyline_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "tallyline_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, Path(PACKAGE.name) / p.relative_to(PACKAGE))
    sc.addPyFile(str(target))
    sc._tallyline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(sc, "_tallyline_shared", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tallyline-shared-")
            sc._tallyline_shared = base
            sc.setCheckpointDir(base)
    return base.rstrip("/")


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were written inside, but for those made with outer=True, and lets shuffles go that they needed."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            remove_path(spark, path)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, label: str, outer: bool = False) -> str:
    """A fresh path in the shared folder; the file system removes it when the driver ends."""
    path = f"{shared_dir(spark)}/tallyline/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    scopes = _SCOPES.get()[:-1] if outer else _SCOPES.get()
    if scopes:
        scopes[-1].append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a table of ours that no later read needs."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def eased(spark: SparkSession) -> None:
    """Collects garbage on the driver if its heap has grown past half of what it may take, and by a tenth since it was smallest.

    Plans and the news of tasks are short-lived there; a JVM that is left alone grows its heap to the limit before it gives any back.
    """
    sc = spark.sparkContext
    runtime = sc._jvm.java.lang.Runtime.getRuntime()
    now = runtime.totalMemory()
    least = min(now, getattr(sc, "_tallyline_heap", now // 2))
    if now > runtime.maxMemory() // 2 and now > 1.1 * least:
        gc.collect()  # frames that Python still holds keep their plans alive
        sc._jvm.System.gc()
        least = runtime.totalMemory()
    sc._tallyline_heap = least


def written(df: DataFrame, label: str, path: str | None = None, outer: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage: writes the frame as Parquet to the shared folder and reads it back."""
    path = path or new_path(df.sparkSession, label, outer)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    eased(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_key(name: str = "doc_id") -> Column:
    """A doc_id as a bigint without nulls."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NULL_ID))


def key_id(name: str = "k") -> Column:
    """The inverse of id_key."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_bytes(name: str = "text") -> Column:
    """A text's UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def size_of(df: DataFrame, name: str = "text") -> int:
    """Bytes of all texts, with a small charge for each row."""
    return int(df.agg(F.sum(F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("bigint") + 16)).first()[0] or 0)


def counted(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs but those whose doc_id is in gone (doc_id; a null means the null ids). Written first and counted, so
    that a short list is broadcast and no text is shuffled."""
    gone = written(gone.select(F.col("doc_id").alias("__gone")).distinct(), "gone", outer=True)
    return docs.join(counted(gone), F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")


def spread_join(rows: DataFrame, small: DataFrame, key: list[str], by: Column) -> DataFrame:
    """rows joined with small by key. small: a written table with one row for each key and __n, how many rows have it.

    The rows of a hot key are dealt over SPREAD tasks by the column `by`, and its row of small is copied to each; the list of
    hot keys is broadcast, for there are at most HOT_SHARE of them. __n is left out of the result.
    """
    total, most = small.agg(F.sum("__n"), F.max("__n")).first()
    least = max(HOT_LEAST, (total or 0) // HOT_SHARE)
    if (most or 0) <= least:
        return rows.join(small.drop("__n"), key)
    hot = F.broadcast(small.where(F.col("__n") > least).select(*key, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).otherwise(0)
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__hot")
    right = small.join(hot, key, "left").withColumn("__salt", F.explode(salts)).drop("__hot", "__n")
    return left.join(right, [*key, "__salt"]).drop("__salt")


def text_slices(pdf, most: int = 4 << 20, name: str = "text") -> Iterator:
    """Parts of a batch of rows with about so many bytes of text."""
    at, ends = 0, np.cumsum([len(t) + 64 for t in pdf[name]])
    while at < len(pdf):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield pdf.iloc[at:to]
        at = to


# ---- counts by classes of hashes: tables of fixed size ----

SLICE_BITS = 14


def count_slices(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A task's counts of all classes, in slices."""
    for i, own in enumerate(np.split(counts, len(counts) >> SLICE_BITS)):
        if own.any():
            yield i, own.astype("<i8").tobytes()


def sum_slices(rows: DataFrame, bits: int) -> np.ndarray:
    """rows: slice, body. The counts of 2 ** bits classes over all tasks; a slice's rows are added as they stream through a task."""

    def work(frames):
        now, total = None, None
        for pdf in frames:
            for i, body in zip(pdf["slice"].tolist(), pdf["body"], strict=True):
                if i != now:
                    if total is not None:
                        yield type(pdf)({"slice": [now], "body": [total.tobytes()]})
                    now, total = i, np.zeros(1 << SLICE_BITS, dtype=np.int64)
                total += np.frombuffer(body, "<i8")
        if total is not None:
            yield type(pdf)({"slice": [now], "body": [total.tobytes()]})

    out = np.zeros(1 << bits, dtype=np.uint32)
    summed = rows.select("slice", "body").repartition("slice").sortWithinPartitions("slice").mapInPandas(work, "slice int, body binary")
    for r in summed.coalesce(FETCHES).toLocalIterator():
        out[r.slice << SLICE_BITS : (r.slice + 1) << SLICE_BITS] = np.minimum(np.frombuffer(r.body, "<i8"), 2**32 - 1)
    return out


# ---- vectorised hashes of words ----

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
_POWERS = np.multiply.accumulate(np.full(4096, _BASE | _ONE, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: equal values stay equal, unequal ones stay unequal."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(0xA0761D6478BD642F) + np.uint64(salt)))


def word_table(buf: bytes, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a buffer in which one byte (space or newline) follows each word.

    Works through the buffer in steps, so that the byte-wide temporaries stay small.
    """
    data = np.frombuffer(buf, dtype=np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    hashes = np.empty(len(ends), dtype=np.uint64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step)))
        lo, hi = int(starts[at]), int(ends[to - 1]) + 1
        own = starts[at:to] - lo
        place = np.arange(hi - lo, dtype=np.int64) - np.repeat(own, np.diff(np.append(own, hi - lo)))
        part = (data[lo:hi].astype(np.uint64) + _ONE) * _POWERS[place & 4095]
        part[ends[at:to] - lo] = 0
        hashes[at:to] = np.add.reduceat(part, own)
        at = to
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64))
