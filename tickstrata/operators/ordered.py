"""The ordered map over (did, timestamp), as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["did", "timestamp"]


def ordered_scan(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*KEYS)


def get(rows: DataFrame, did: int, timestamp: int) -> DataFrame:
    return rows.where((F.col("did") == did) & (F.col("timestamp") == timestamp))


def contains(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `keys` (did, timestamp) that the map has."""
    return keys.join(rows.select(*KEYS), KEYS, "left_semi")


def delete(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(*KEYS), KEYS, "left_anti")


def _from(did: int, timestamp: int) -> Column:
    return (F.col("did") > did) | ((F.col("did") == did) & (F.col("timestamp") >= timestamp))


def _to(did: int, timestamp: int) -> Column:
    return (F.col("did") < did) | ((F.col("did") == did) & (F.col("timestamp") <= timestamp))


def starting_at(rows: DataFrame, did: int, timestamp: int) -> DataFrame:
    """Keys from (did, timestamp) on, itself included, in order. The plain bound on did lets the scan skip row groups."""
    return ordered_scan(rows.where((F.col("did") >= did) & _from(did, timestamp)))


def between(rows: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Keys from low to high, both included, in order of (did, timestamp)."""
    if low > high:
        raise ValueError(f"the range from {low} to {high} is empty")
    return ordered_scan(rows.where(F.col("did").between(low[0], high[0]) & _from(*low) & _to(*high)))
