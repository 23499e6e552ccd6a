"""The binary frame of a log record, as column expressions.

Big-endian: magic 0x4E, CRC-32 of all that follows it, operation (1 byte), priority (1), id (8), payload length (4), payload.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC, HEADER, MAX_PAYLOAD = 0x4E, 19, 64 << 20


def _bytes(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


def encode(op: Column, priority: Column, id_: Column, payload: Column) -> Column:
    """The frame; null for a payload over the limit, for it could not be read back."""
    payload = F.coalesce(payload.cast("binary"), F.unhex(F.lit("")))
    body = F.concat(_bytes(op, 1), _bytes(priority, 1), _bytes(id_, 8), _bytes(F.octet_length(payload), 4), payload)
    return F.when(F.octet_length(payload) <= MAX_PAYLOAD, F.concat(F.unhex(F.lit(f"{MAGIC:02X}")), _bytes(F.crc32(body), 4), body))


def _number(frame: Column, at: int, width: int) -> Column:
    """Unsigned, so eight bytes need a decimal."""
    return F.conv(F.hex(F.substring(frame, at + 1, width)), 16, 10).cast("decimal(20,0)")


def decode(frame: Column) -> Column:
    """op, priority, id, payload; null for a short, long, foreign, damaged or unknown frame. Ids beyond a bigint are refused."""
    size = F.octet_length(frame)
    length = _number(frame, 15, 4)
    valid = (size >= HEADER) & (F.substring(frame, 1, 1) == F.unhex(F.lit(f"{MAGIC:02X}")))
    valid = valid & (length <= MAX_PAYLOAD) & (size == HEADER + length)
    valid = valid & (F.crc32(F.substring(frame, 6, MAX_PAYLOAD + HEADER)) == _number(frame, 1, 4)) & (_number(frame, 5, 1) <= 5) & (_number(frame, 7, 8) < F.lit(str(1 << 63)).cast("decimal(20,0)"))
    record = F.struct(
        _number(frame, 5, 1).cast("bigint").alias("op"), _number(frame, 6, 1).cast("bigint").alias("priority"),
        F.when(_number(frame, 7, 8) < F.lit(str(1 << 63)).cast("decimal(20,0)"), _number(frame, 7, 8)).cast("bigint").alias("id"), F.substring(frame, HEADER + 1, MAX_PAYLOAD).alias("payload"),
    )
    return F.when(valid, record)
