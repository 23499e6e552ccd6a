"""State of a queue as a fold of its log: latest event per task, ready order, leases, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.plans.views import ACKED, CREATED, DEAD, EXPIRED, LEASED, NACKED

#: Positions that one block of a dispatch order spans.
BLOCK = 1 << 20


def latest(log: DataFrame, keys: tuple[str, ...] = ("id",), columns: tuple[str, ...] = ("op", "priority", "retries", "consumer_id", "expire_ts")) -> DataFrame:
    """The latest event of each task. The values are fixed-width, so that partial hash aggregation does the work."""
    return log.groupBy(*keys).agg(*[F.max_by(c, "pos").alias(c) for c in columns], F.max("pos").alias("pos"))


def ready(log: DataFrame, now: int, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Tasks that can be dispatched at `now`: created or given back, or leased with the lease over. retries stay as they are
    for the last kind; a created task has none."""
    s = latest(log, keys)
    is_ready = F.col("op").isin(CREATED, NACKED, EXPIRED) | ((F.col("op") == LEASED) & (F.col("expire_ts") <= now))
    return s.where(is_ready).select(*keys, "priority", F.when(F.col("op") == CREATED, 0).otherwise(F.col("retries")).cast("bigint").alias("retries"), "pos")


def leases(log: DataFrame, now: int, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Leases that hold at `now`."""
    return latest(log, keys).where((F.col("op") == LEASED) & (F.col("expire_ts") > now)).select(*keys, "consumer_id", "expire_ts", "retries", "priority", "pos")


def dispatch_rank(tasks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Numbers tasks in dispatch order (priority descending, position ascending) without sorting them in one task.

    Ranks are counted within (priority, block of positions) and shifted by the sizes of the blocks before.
    """
    t = tasks.withColumn("__block", F.floor(F.col("pos") / block).cast("bigint"))
    sizes = t.groupBy("priority", "__block").agg(F.count("*").alias("__n"))
    before = Window.orderBy(F.desc("priority"), "__block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("priority", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("priority", "__block").orderBy("pos"))
    return t.withColumn("__rank", own).join(shifts, ["priority", "__block"]).select(*tasks.columns, (F.col("__rank") + F.col("__shift")).cast("bigint").alias("dispatch_rank"))


def pop(tasks: DataFrame, k: int, order: str = "pos") -> DataFrame:
    """The next k tasks: a top-k, no full sort."""
    return tasks.orderBy(F.desc("priority"), F.asc(order)).limit(k)


def pop_per_queue(tasks: DataFrame, k: int, order: str = "pos", queue: str = "queue") -> DataFrame:
    """The next k tasks of each queue; ranks beyond k are cut before the shuffle."""
    w = Window.partitionBy(queue).orderBy(F.desc("priority"), F.asc(order))
    return tasks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def payloads(log: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The payload of each live task: of the last Created after the last end of the task, else of the first later event. The
    place is found first, with columns of fixed width only; payloads of other events are never shuffled with it."""
    slim = log.select(*keys, "op", "pos")
    ended = slim.where(F.col("op").isin(ACKED, DEAD)).groupBy(*keys).agg(F.max("pos").alias("__end"))
    live = slim.join(ended, list(keys), "left").where("__end is null or pos > __end")
    made, other = F.max(F.when(F.col("op") == CREATED, F.col("pos"))), F.min(F.when(F.col("op").isin(LEASED, NACKED, EXPIRED), F.col("pos")))
    places = live.groupBy(*keys).agg(F.coalesce(made, other).alias("pos"))
    return log.select(*keys, "pos", "payload").join(places, [*keys, "pos"]).select(*keys, "payload")


def status(tasks: DataFrame, queue: str = "queue") -> DataFrame:
    return tasks.groupBy(queue).agg(F.count_if(F.col("state") == "ready").alias("ready_tasks"), F.count_if(F.col("state") == "leased").alias("active_leases"))


def next_id(log: DataFrame, high_water: int = 0) -> DataFrame:
    """The next id to give: one more than any id seen, and than a stored high-water mark, so that compaction cannot free ids."""
    return log.agg((F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(high_water)) + 1).alias("next_id"))
