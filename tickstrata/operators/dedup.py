"""First write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """For each key the row that arrived first.

    row_number() = 1 plans as a group limit before and after the shuffle, so of a hot key only one
    row for each task is moved. `arrival` has to order the rows of a key completely.
    """
    order = Window.partitionBy(*keys).orderBy(*arrival)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def changes(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """The rows whose key differs from that of the row before, in order of (keys, arrival): as a merge of sorted runs drops repeats."""
    before = F.lag(F.lit(True)).over(Window.partitionBy(*keys).orderBy(*arrival))
    return rows.withColumn("_same", before).where("_same IS NULL").drop("_same")
