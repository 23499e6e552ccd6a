"""Pushes, acknowledgements, rejections, expiries and retry counters as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.plans.views import ACKED, CREATED, DEAD, EXPIRED, LEASED, MAX_FAILURES, NACKED


def push(log: DataFrame | None, arrivals: DataFrame, first_id: int, order: str, keep: tuple[str, ...] = ("payload",), blocks: int = 4096) -> DataFrame:
    """arrivals (order: a bigint column; priority; keep) as Created events with ids that follow on without gaps.

    Arrivals are numbered within ranges of the order, which the sizes of the ranges before shift, so no task sees all of them.
    """
    low, high = arrivals.agg(F.min(order), F.max(order)).first()
    width = 1 if low is None else (high - low) // blocks + 1
    t = arrivals.withColumn("__block", F.floor((F.col(order) - F.lit(low or 0)) / width))
    sizes = t.groupBy("__block").agg(F.count("*").alias("__n"))  # at most `blocks` + 1 rows
    shifts = sizes.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    n = F.row_number().over(Window.partitionBy("__block").orderBy(order))
    numbered = t.withColumn("__i", n).join(F.broadcast(shifts), "__block")
    rows = numbered.select((F.col("__i") + F.col("__shift") - 1 + F.lit(first_id)).cast("bigint").alias("id"), F.lit(CREATED).cast("bigint").alias("op"), F.col("priority").cast("bigint").alias("priority"), *keep)
    return rows if log is None else log.unionByName(rows, allowMissingColumns=True)


def validate(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """requests (id, consumer_id) against leases (id, consumer_id, retries): ok, not_found or conflict. A lease holds while its
    row is there, also past its end."""
    held = leases.select("id", F.col("consumer_id").alias("__holder"), "retries")
    result = F.when(F.col("__holder").isNull(), "not_found").when(F.col("__holder") != F.col("consumer_id"), "conflict").otherwise("ok")
    return requests.join(held, "id", "left").select("id", "consumer_id", result.alias("result"), "retries")


def http_status(result: Column) -> Column:
    """Response code and error of a result."""
    code = F.when(result == "ok", 200).when(result == "not_found", 404).when(result == "conflict", 409).when(result == "bad_request", 400).otherwise(500)
    return code.cast("bigint")


def failed(leases: DataFrame, op: int) -> DataFrame:
    """What a rejection or expiry makes of leases: one more failure, and the end of the task at the third."""
    n = F.col("retries") + 1
    return leases.withColumns({"retries": n, "op": F.when(n >= MAX_FAILURES, DEAD).otherwise(op).cast("bigint"), "requeued": n < MAX_FAILURES})


def expired(leases: DataFrame, now: int) -> DataFrame:
    return failed(leases.where(F.col("expire_ts") <= now), EXPIRED)


def failures_since_ack(log: DataFrame) -> DataFrame:
    """For each failure, how many the task has had since its last acknowledgement."""
    w = Window.partitionBy("id").orderBy("pos")
    runs = log.select("id", "pos", "op", F.sum(F.when(F.col("op") == ACKED, 1).otherwise(0)).over(w).alias("__run"))
    bad = F.col("op").isin(NACKED, EXPIRED)
    count = F.sum(F.when(bad, 1).otherwise(0)).over(Window.partitionBy("id", "__run").orderBy("pos"))
    return runs.withColumn("failures", count.cast("bigint")).where(bad).select("id", "pos", "failures")


def dead_letters(log: DataFrame) -> DataFrame:
    """Events that end a task as dead, or would: the third and later failures. A view of ours; compaction drops such tasks."""
    return failures_since_ack(log).where(F.col("failures") >= MAX_FAILURES)


def deliveries(log: DataFrame) -> DataFrame:
    return log.groupBy("id").agg(F.count_if(F.col("op") == LEASED).alias("deliveries"), F.count_if(F.col("op") == ACKED).alias("acks"))


def late_acks(log: DataFrame) -> DataFrame:
    """Acknowledgements of tasks that were not leased at that time."""
    before = F.lag("op").over(Window.partitionBy("id").orderBy("pos"))
    return log.select("id", "pos", "op", before.alias("before")).where((F.col("op") == ACKED) & (F.coalesce("before", F.lit(-1)) != LEASED)).select("id", "pos", F.coalesce("before", F.lit(-1)).alias("before"))
