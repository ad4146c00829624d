"""Counts, bounds and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstrata.functions.columns import approximate_bytes


def bounds(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("timestamp").alias("min_time"), F.max("timestamp").alias("max_time"), F.count("*").alias("rows"))


def ingest_size(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows and the bytes that the write buffer counts; repeats count, too."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(approximate_bytes("value")).alias("bytes"))


def running_offset(rows: DataFrame, length: str, by: list[str], order: list[str], cell: list[Column]) -> DataFrame:
    """`rows` with the offset of each row's block within its run.

    cell: columns that never fall along `order`. Sums are run within a cell, and over the cells' totals, so no task
    sorts a whole run.
    """
    names = [f"_cell{k}" for k in range(len(cell))]
    rows = rows.select("*", *(c.alias(n) for c, n in zip(cell, names)))
    earlier = lambda parts, along: Window.partitionBy(*parts).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda column, parts, along: F.coalesce(F.sum(column).over(earlier(parts, along)), F.lit(0))
    cells = rows.groupBy(*by, *names).agg(F.sum(length).alias("_total"))
    cells = cells.select(*by, *names, before("_total", by, names).alias("_before"))
    within = rows.withColumn("_within", before(length, [*by, *names], order))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, *names]]
    joined = within.alias("r").join(cells.alias("c"), same).select("r.*", (F.col("_before") + F.col("_within")).alias("offset"))
    return joined.drop("_within", *names)


def payload_sizes(rows: DataFrame) -> DataFrame:
    """Bytes of each row's registers as JSON, at ten bytes a register, and as a packed list of varints; of a repeated key the last value counts."""
    last = lambda k, i: F.coalesce(F.array_position(F.slice("key", i + 2, F.size("key")), k) == 0, F.lit(True))
    pairs = F.filter(F.arrays_zip("key", "value"), lambda p, i: last(p["key"], i))
    varint = lambda x: F.when(x < 0, 10).otherwise(F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7))).cast("int")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + varint(x.cast("long")))
    packed = rows.select("*", pairs.alias("_pairs")).select("*", (total(F.col("_pairs.key")) + total(F.col("_pairs.value"))).alias("_packed"))
    return packed.select(
        "did", "timestamp", F.length(F.to_json(F.map_from_entries("_pairs"))).alias("json_bytes"), (F.size("_pairs") * 10).alias("fixed_bytes"),
        F.when(F.col("_packed") == 0, 0).otherwise(1 + varint(F.col("_packed").cast("long")) + F.col("_packed")).alias("packed_bytes"),
    )


def device_index(rows: DataFrame, length: Column, entry: int = 25) -> DataFrame:
    """The per-device index of a run: bounds, bytes of its blocks and of its index entries, the place of its first block, and no flag."""
    by = rows.groupBy("did").agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.sum(length).alias("size"), (F.count("*") * entry).alias("first_index_size")
    )
    group = F.shiftright("did", 16)
    placed = running_offset(by.withColumn("_one", F.lit(0)), "size", ["_one"], ["did"], [group]).drop("_one")
    return placed.withColumn("flag", F.lit(0))
