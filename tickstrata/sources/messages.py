"""Source messages: JSON bodies to telemetry rows.

Registers are exact 64-bit integers. Rows that cannot be stored faithfully (a register pair that is
too short, a fractional value, an identifier or time out of range, a payload of the wrong shape) go
to quarantine instead of breaking the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstrata.functions.columns import event_time_ms, in_domain, in_time, register_keys, register_values
from tickstrata.model import DATA_MESSAGE, FUTURE_MS, SOURCE_BODY


@dataclass(frozen=True)
class Ingested:
    rows: DataFrame  # did, timestamp, created_at, key, value, offset (the order of arrival within a time)
    quarantine: DataFrame  # did, body, reason


def parse(messages: DataFrame) -> DataFrame:
    """`messages` (did, created_at_ms, body, ...) with the parsed body in `m` and the event's time in `event_ms`."""
    parsed = messages.withColumn("m", F.from_json("body", SOURCE_BODY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    time = event_time_ms(F.col("m.timestamp"), F.col("m.msg_type"), F.col("m.data"), F.col("m.data.timestamp"), F.col("created_at_ms"))
    return parsed.withColumn("event_ms", time)


def valid_json(parsed: DataFrame) -> DataFrame:
    return parsed.where("m IS NOT NULL AND m._corrupt IS NULL")


def data_messages(parsed: DataFrame, now_ms: int, ahead_ms: int = FUTURE_MS) -> DataFrame:
    """Data messages with a payload, none of them from the far future."""
    return valid_json(parsed).where((F.col("m.msg_type") == DATA_MESSAGE) & F.col("m.data").isNotNull() & in_time(F.col("event_ms"), now_ms, ahead_ms))


def pivot(rows: DataFrame, regs: str) -> DataFrame:
    """`rows` with register pairs [[key, value], ...] as two arrays `key` and `value`."""
    pairs = F.coalesce(F.col(regs), F.array().cast("array<array<bigint>>"))
    return rows.withColumn("key", register_keys(pairs)).withColumn("value", register_values(pairs))


def ingest(messages: DataFrame, now_ms: int, created_at: int | None = None, ahead_ms: int = FUTURE_MS) -> Ingested:
    """created_at: nanoseconds stamped on the rows; by default the source's own time. Times that nanoseconds cannot hold go to quarantine."""
    parsed = parse(messages)
    stamp = F.lit(created_at).cast("long") if created_at is not None else F.try_multiply(F.col("created_at_ms"), F.lit(1_000_000).cast("long"))
    rows = pivot(data_messages(parsed, now_ms, ahead_ms), "m.data.regs")
    time = F.try_multiply(F.col("event_ms"), F.lit(1_000_000).cast("long"))
    rows = rows.select("did", time.alias("timestamp"), stamp.alias("created_at"), "key", "value", "offset", "body")
    whole = F.forall("key", lambda k: k.isNotNull()) & F.forall("value", lambda v: v.isNotNull())
    good = F.coalesce(whole & in_domain("did", "timestamp") & F.col("created_at").isNotNull(), F.lit(False))
    reason = F.when(~whole, "register pair").otherwise("identifier or time out of range")
    broken = parsed.where("m IS NULL OR m._corrupt IS NOT NULL").select("did", "body", F.lit("body").alias("reason"))
    refused = rows.where(~good).select("did", "body", reason.alias("reason"))
    return Ingested(rows.where(good).drop("body"), broken.unionByName(refused))
