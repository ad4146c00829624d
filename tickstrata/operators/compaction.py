"""What to compact, and how runs merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstrata.functions.columns import shard_id
from tickstrata.model import MIN_RUNS, SHARD_NS, SMALL_RUN
from tickstrata.operators.dedup import first_wins


def plan(catalog: DataFrame, small: int = SMALL_RUN, least: int = MIN_RUNS) -> DataFrame:
    """shard_id, files, names (by size): the shards of `catalog` (shard_id, size, name) with more than `least` small files."""
    found = catalog.where(F.col("size") < small).groupBy("shard_id")
    names = F.array_sort(F.collect_list(F.struct("size", "name")))["name"]
    return found.agg(F.count("*").alias("files"), names.alias("names")).where(F.col("files") > least)


def merge(rows: DataFrame, arrival: tuple[str, ...] | list[str] = ("created_at",)) -> DataFrame:
    """Rows of several runs without repeats of (did, timestamp): the row of the oldest run stays, then the first by `arrival`."""
    return first_wins(rows, ["did", "timestamp"], ["run_created_at", *arrival])


def reshard(rows: DataFrame, width: int = SHARD_NS) -> DataFrame:
    return rows.withColumn("shard_id", shard_id("timestamp", width))


def remove_ranges(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows outside all `tombstones` (did, start, end, created): one covers its device's rows of the range made up to `created`."""
    t = tombstones.select(F.col("did").alias("_did"), "start", "end", "created")
    covered = (F.col("did") == F.col("_did")) & F.col("timestamp").between(F.col("start"), F.col("end")) & (F.col("created_at") <= F.col("created"))
    return rows.join(t, covered, "left_anti")
