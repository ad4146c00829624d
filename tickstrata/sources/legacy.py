"""Import of older index files: records of 25 bytes, big-endian: did 4, offset 8, length 4, flag 1, timestamp 8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 25
FIELDS = {"did": (0, 4), "offset": (4, 8), "length": (12, 4), "flag": (16, 1), "timestamp": (17, 8)}


def _number(content: Column, start: Column, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, start + 1, F.lit(size))), 16, 10).try_cast("long")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """path, did, offset, length, flag, timestamp of every whole record of the files at `path`.

    A file is one row of Spark's until its records are cut, so it can have 2 GB at most. Numbers beyond 63 bits are null; what follows
    the last whole record is left out, and tails() tells of it.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    starts = F.when(F.col("length") >= RECORD, F.sequence(F.lit(0), (F.floor(F.col("length") / RECORD) - 1).cast("int")))
    rows = files.select("path", "content", F.explode(starts).alias("k"))
    columns = [_number(F.col("content"), F.col("k") * RECORD + at, size).alias(name) for name, (at, size) in FIELDS.items()]
    return rows.select("path", *columns)


def tails(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes: the files whose last record is cut off."""
    files = spark.read.format("binaryFile").load(path).select("path", (F.col("length") % RECORD).alias("bytes"))
    return files.where("bytes > 0")


def encode_index(rows: DataFrame) -> DataFrame:
    """The 25-byte record of each row, as `record`."""
    parts = [F.lpad(F.hex(name), 2 * size, "0") for name, (_, size) in FIELDS.items()]
    return rows.withColumn("record", F.unhex(F.concat(*parts)))
