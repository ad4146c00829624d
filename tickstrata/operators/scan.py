"""Device scans, and sweeps of many windows as one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstrata.functions.columns import shard_id
from tickstrata.model import SHARD_NS


def shard_of(timestamp: int, width: int = SHARD_NS) -> int:
    """shard_id() of a plain number."""
    return abs(timestamp) // width * (1 if timestamp >= 0 else -1)


def device_scan(rows: DataFrame, did: int, start: int, end: int, granularity: str = "exact", width: int = SHARD_NS) -> DataFrame:
    """Rows of one device. "exact": start <= timestamp <= end; "shard": every row of the shards from start's to end's.

    The shard predicate is given beside the one on time, as only it can prune partitions.
    """
    if granularity not in ("exact", "shard"):
        raise ValueError(f"granularity is {granularity!r}")
    found = rows.where(F.col("shard_id").between(shard_of(start, width), shard_of(end, width)) & (F.col("did") == did))
    return found.where(F.col("timestamp").between(start, end)) if granularity == "exact" else found


def sweep(rows: DataFrame, windows: DataFrame, granularity: str = "exact") -> DataFrame:
    """Rows of `windows` (window_id, did, start, end) joined to the device rows in them.

    Each window is spread over its shards, so the join is an equality on (did, shard_id), not a range. As in
    device_scan(), a window that ends before it starts, but in the same shard, has all rows of that shard in mode "shard".
    """
    first, last = shard_id("start"), shard_id("end")
    spread = windows.withColumn("shard_id", F.explode(F.when(first <= last, F.sequence(first, last))))
    joined = spread.join(rows, ["did", "shard_id"])
    return joined.where(F.col("timestamp").between(F.col("start"), F.col("end"))) if granularity == "exact" else joined


def read_response(rows: DataFrame) -> DataFrame:
    """One row: the times of a scan and its values as text, in order of time.

    The answer to one request, as big as the rows of its device and range.
    """
    pair = F.array_sort(F.collect_list(F.struct("timestamp", "created_at", F.concat_ws(",", F.col("value").cast("array<string>")).alias("data"))))
    return rows.agg(pair.alias("p")).select(F.col("p.timestamp").alias("timestamp"), F.col("p.data").alias("data"))
