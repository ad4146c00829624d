"""The register lists of devices: written once for each device, by its first message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstrata.operators.dedup import first_wins


def first_fields(rows: DataFrame, arrival: list[str]) -> DataFrame:
    """did, key: the register list of each device's first row."""
    return first_wins(rows, ["did"], arrival).select("did", "key")


def new_devices(rows: DataFrame, registry: DataFrame) -> DataFrame:
    return rows.join(registry.select("did"), "did", "left_anti")


def extend(registry: DataFrame, rows: DataFrame, arrival: list[str]) -> DataFrame:
    """`registry` with the devices of `rows` that it doesn't have yet; lists that are there never change."""
    return registry.unionByName(first_fields(new_devices(rows, registry), arrival))


def conflicts(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows whose own register list differs from the registered one, so that positions would decode wrongly."""
    return rows.join(registry.withColumnRenamed("key", "registered"), "did").where(~F.col("key").eqNullSafe(F.col("registered")))


def explode(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """did, timestamp, register, reading: a row's values by the names of its device's registers.

    The join is left to the optimizer: the registry grows with the devices, so only its size decides whether it is broadcast.
    """
    zipped = F.arrays_zip(F.col("key").alias("register"), F.col("value").alias("reading"))
    joined = rows.join(registry, "did").select("did", "timestamp", F.explode(zipped).alias("r"))
    return joined.select("did", "timestamp", F.col("r.register").alias("register"), F.col("r.reading").alias("reading"))
