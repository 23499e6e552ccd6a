"""Batches of durable writes: arrivals that share one flush, and segments of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def idle_batches(arrivals: DataFrame, idle_us: int, queue: str = "queue") -> DataFrame:
    """arrivals: queue, at (microseconds), seq. A batch ends when nothing arrived for `idle_us` or longer."""
    w = Window.partitionBy(queue).orderBy("at", "seq")
    new = F.when(F.col("at") - F.lag("at").over(w) >= idle_us, 1).otherwise(0)
    return arrivals.withColumn("__new", new).withColumn("batch", F.sum("__new").over(w).cast("bigint")).drop("__new")


def _in_order(rows: DataFrame, queue: str, order: list[str]) -> DataFrame:
    return rows.repartition(queue).sortWithinPartitions(queue, *order)


def capped_batches(arrivals: DataFrame, window_us: int = 2000, most: int = 64, idle_us: int = 0, queue: str = "queue", force: str | None = None) -> DataFrame:
    """As a committer closes batches: when `most` wait, or the first has waited `window_us`, or, with idle_us above 0, after an
    idle time, or behind an arrival whose boolean column `force` is true (null is false). Sequential in each queue; a queue
    streams through its task with a constant state."""
    forced = F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = batch = start = last = n = closed = None
        for pdf in frames:
            out = []
            for q, at, flush in zip(pdf[queue], pdf["at"].tolist(), pdf["__force"].tolist(), strict=True):
                if q != name:
                    name, batch, start, n = q, 0, at, 0
                elif closed or n >= most or at - start >= window_us or (idle_us and at - last >= idle_us):
                    batch, start, n = batch + 1, at, 0
                n, last, closed = n + 1, at, flush
                out.append(batch)
            yield pd.DataFrame({queue: pdf[queue], "at": pdf["at"], "seq": pdf["seq"], "batch": out})

    return _in_order(arrivals.select(queue, "at", "seq", forced.alias("__force")), queue, ["at", "seq"]).mapInPandas(work, f"{queue} string, at bigint, seq bigint, batch bigint")


def rotate(frames: DataFrame, limit: int, queue: str = "queue") -> DataFrame:
    """frames: queue, seq, size. Greedy segments: a new one starts before a frame if the last has reached the limit."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = segment = offset = None
        for pdf in parts:
            out = []
            for q, size in zip(pdf[queue], pdf["size"].tolist(), strict=True):
                if q != name:
                    name, segment, offset = q, 1, 0
                elif offset >= limit:
                    segment, offset = segment + 1, 0
                out.append((segment, offset))
                offset += size
            yield pd.DataFrame({queue: pdf[queue], "seq": pdf["seq"], "segment_id": [s for s, _ in out], "offset": [o for _, o in out]})

    return _in_order(frames.select(queue, "seq", "size"), queue, ["seq"]).mapInPandas(work, f"{queue} string, seq bigint, segment_id bigint, offset bigint")
