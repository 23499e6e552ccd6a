"""JSON bodies of requests and responses, and errors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUSH = "payload string, priority int"


def parse_push(body: Column) -> Column:
    """payload (binary, null if it is not base64), priority (0 to 255, 0 where missing, null if out of range) and status (400 for
    either fault, else 201) of a push request."""
    r = F.from_json(body, PUSH)
    payload, priority = F.try_to_binary(r["payload"], F.lit("base64")), F.coalesce(r["priority"], F.lit(0)).cast("bigint")
    fine = priority.between(0, 255)
    return F.struct(payload.alias("payload"), F.when(fine, priority).alias("priority"), F.when(payload.isNotNull() & fine, 201).otherwise(400).cast("bigint").alias("status"))


def push_response(id_: Column) -> Column:
    return F.to_json(F.struct(id_.alias("id")))


def pop_response(id_: Column, payload: Column, priority: Column, retries: Column) -> Column:
    return F.to_json(F.struct(id_.alias("id"), F.base64(payload).alias("payload"), priority.alias("priority"), retries.alias("retries")))


def error_response(error: Column, message: Column) -> Column:
    return F.to_json(F.struct(error.alias("error"), message.alias("message")))
