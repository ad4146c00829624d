"""Column expressions of the model; all of them are built-ins, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickstrata.model import DATA_MESSAGE, DID_LIMIT, SHARD_NS


def shard_id(timestamp: str | Column, width: int = SHARD_NS) -> Column:
    """Shard of a nanosecond time; integer division truncates toward zero, so -1 is in shard 0."""
    t = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.call_function("div", t, F.lit(width))


def nanos(timestamp: str | Column) -> Column:
    """Epoch nanoseconds of a timestamp; a zoneless one counts in the session's zone, which has to be UTC."""
    t = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.unix_micros(t.cast("timestamp")) * 1000


def event_time_ms(top: Column, msg_type: Column, data: Column, data_time: Column, created: Column) -> Column:
    """Time of an event: the message's own, else that of the payload of a data message, else when the source got it."""
    own = (top.isNotNull()) & (top != 0)
    return F.when(own, top).when((msg_type == DATA_MESSAGE) & data.isNotNull(), F.coalesce(data_time, F.lit(0))).otherwise(created)


def in_time(event_ms: Column, now_ms: int, ahead_ms: int) -> Column:
    """Events may be up to `ahead_ms` ahead of now, and of any age."""
    return event_ms <= now_ms + ahead_ms


def register_keys(regs: str | Column) -> Column:
    return F.transform(regs, lambda r: F.get(r, F.lit(0)).try_cast("int"))


def register_values(regs: str | Column) -> Column:
    return F.transform(regs, lambda r: F.get(r, F.lit(1)))


def in_domain(did: str, timestamp: str) -> Column:
    return F.col(did).between(0, DID_LIMIT - 1) & (F.col(timestamp) >= 0)


def is_zip(flag: str) -> Column:
    return F.col(flag).bitwiseAND(1) > 0


def is_compact(flag: str) -> Column:
    return F.col(flag).bitwiseAND(2) > 0


def field_folder(did: str) -> Column:
    """The first two characters of the did, which is padded with zeros to two: the registry's fan-out."""
    s = F.col(did).cast("string")
    return F.substring(F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s), 1, 2)


def run_part(name: str, k: int) -> Column:
    """Part k of a run's file name <shard size>_<shard>_<created at>_<kind>."""
    return F.get(F.split(F.col(name), "_"), F.lit(k))


def approximate_bytes(value: str) -> Column:
    """The size that the write buffer counts for a row."""
    return F.size(value) * 4 + 12
