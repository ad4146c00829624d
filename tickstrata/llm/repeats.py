"""Rows that repeat: counted before they are shuffled, and dealt out again afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstrata.session import durable

PORTION = 4096  # repeats of a row that one row stands for while they are dealt to tasks


def counted(df: DataFrame, name: str) -> DataFrame:
    """The distinct rows of `df` with `n`, how often each stands in it; written. A row that very many repeat is combined before the shuffle."""
    return durable(df.groupBy(*df.columns).agg(F.count("*").alias("n")), name)


def dealt(rows: DataFrame, portion: int = PORTION) -> DataFrame:
    """Each of `rows` (n, ...; a written table, as it is read twice) n times, with `k` from 0 on.

    What stands for more than `portion` repeats is cut, and the cuts go to different tasks.
    """

    def numbers(first: Column, end: Column) -> Column:
        return F.explode(F.sequence(first, end - 1)).alias("k")

    columns = [c for c in rows.columns if c != "n"]
    zero = F.lit(0).cast("long")
    few = rows.where(F.col("n") <= portion).select(*columns, numbers(zero, F.col("n")))
    cuts = F.explode(F.sequence(zero, F.col("n") - 1, F.lit(portion).cast("long"))).alias("cut")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = rows.where(F.col("n") > portion).select("*", cuts).repartition(parts, *columns, "cut")
    return few.unionByName(many.select(*columns, numbers(F.col("cut"), F.least("n", F.col("cut") + portion))))
