"""Queue data derived from the driver's tables, and the constants of the queue's state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operation codes of the log; fixed values of the format.
CREATED, LEASED, ACKED, NACKED, EXPIRED, DEAD = range(6)
#: Failures after which a task is dead.
MAX_FAILURES = 3
SEGMENT_EVENTS = 1000
#: The time at which the derived log is read, in the units of its lease ends.
NOW = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(segment: Column, offset: Column) -> Column:
    """One bigint that orders (segment, offset): offsets are below 2^36. A fixed-width key keeps argmax in hash aggregation."""
    return segment.cast("bigint") * F.lit(1 << 36) + offset.cast("bigint")


def queue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: id, pos, segment_id, op, priority, retries, consumer_id, expire_ts, payload."""
    e = table(spark, sf_dir, "events")
    kinds = {"signup": CREATED, "view": LEASED, "purchase": ACKED, "click": NACKED}
    op = F.lit(EXPIRED)
    for name, code in kinds.items():
        op = F.when(F.col("event_type") == name, code).otherwise(op)
    n = F.col("event_id")
    return e.select(
        F.col("user_id").alias("id"), n.alias("pos"), (n / SEGMENT_EVENTS).cast("bigint").alias("segment_id"), op.cast("bigint").alias("op"),
        (F.col("user_id") * 37 % 256).alias("priority"), (n % 3).alias("retries"), (n % 7).alias("consumer_id"), (n % 97).alias("expire_ts"), F.col("props").alias("payload"),
    )


def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tasks: id, queue, priority (larger goes first), state."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    state = F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "P", "leased").otherwise("acked")
    o = o.select(F.col("o_orderkey").alias("id"), "o_custkey", (6 - F.substring("o_orderpriority", 1, 1).cast("bigint")).alias("priority"), state.alias("state"))
    return o.join(c.select("c_custkey", F.col("c_mktsegment").alias("queue")), F.col("o_custkey") == F.col("c_custkey")).select("id", "queue", "priority", "state")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


def lease_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a log of leases: id, op, consumer_id, retries, pos (a struct, for no narrower key is unique)."""
    x = table(spark, sf_dir, "lineitem")
    op = F.when(F.col("l_returnflag") == "R", NACKED).when(F.col("l_returnflag") == "N", LEASED).otherwise(ACKED)
    return x.select(F.col("l_orderkey").alias("id"), op.cast("bigint").alias("op"), (F.col("l_suppkey") % 4).alias("consumer_id"), (F.col("l_linenumber") % 3).cast("bigint").alias("retries"), F.struct(*LINE_ORDER).alias("pos"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as acknowledgement requests: id, consumer_id."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("consumer_id"))
