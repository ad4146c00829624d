"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over its source's size. Within a source the
documents stand in a fixed order; their expected copies are summed up, one random offset is added,
and a document is taken once for each whole number that its step of the running sum crosses. The
order goes by size class first, so the sample is spread evenly over short and long documents and the
words taken come near the target.

The running sum is the document's rank times the source's rate, so only ranks are needed. A rank is
the rank within a part of a small cell (source, size class, hash bucket; a part is a doc_id's rows by the
first bits of their texts' hashes) plus the counts of the parts and cells before it, and rows that are the
same are counted: no task sorts a whole source or all rows of one doc_id, even if it holds most rows.

Defined cases: a null text or one without words has size 0 and takes no words; null is a source of
its own, after all others; a source without words has target 0; repeated rows count each; further
columns are ignored here and kept by resample(); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstrata.llm.repeats import counted, dealt
from tickstrata.session import discard, durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # times a source's size, and copies of a document
KEY = ["source_key", "size_class", "bucket"]
PART = 56  # bits of a text's hash after those that give its part


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts sources by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def size_class() -> Column:
    """Eight classes for each power of two."""
    bits = "length(bin(size))"
    return F.expr(f"{bits} * 8 + CAST(shiftright(size * 8, {bits} - 1) AS INT) % 8")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source_key, source_size, target: shares of all words by weight, capped at `most` times a source's size.

    With the sources in order of size per weight, the share per unit of weight that is left after capping the
    first k rises while caps bind and falls after; its maximum is the level of the sources that aren't capped.
    """
    by = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy("source_key")) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    full = Window.orderBy((F.col("source_size") * most / F.col("weight")), "source_key")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    by = by.withColumn("level", left.cast("double") / weight.cast("double"))
    level = F.max("level").over(every)
    return by.select(
        "source_key", "source_size", F.least((F.col("source_size") * most).cast("double"), level * F.col("weight")).alias("target")
    )


def ranked(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, text_hash, size, source_key, source_size, target, rate, offset, n, before: the distinct rows of `docs` (doc_id, text, source), written.

    n: how often a row stands in `docs`; before: the rows of its source that stand before it.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = counted(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), source_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size")),
        "mixing-rows",
    )
    rows = rows.select("*", size_class().alias("size_class"), order.alias("place"), F.shiftright("text_hash", PART).alias("part"))
    rows = rows.withColumn("bucket", F.substring("place", 1, 2))
    running = Window.rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda of, by, order: F.coalesce(F.sum(of).over(running.partitionBy(*by).orderBy(*order)), F.lit(0))
    sums = rows.groupBy(*KEY, "place", "part").agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("words"))
    sums = durable(sums, "mixing-sums")
    cells = sums.groupBy(*KEY).agg(F.sum("rows").alias("rows")).select(*KEY, ahead("rows", ["source_key"], ["size_class", "bucket"]).alias("cell_before"))
    by_source = targets(sums.select("source_key", F.col("words").alias("size")), weights, most)
    parts = sums.select(*KEY, "place", "part", ahead("rows", KEY, ["place", "part"]).alias("part_before"))
    parts = parts.join(cells.join(by_source, "source_key"), KEY)
    rows = rows.select("*", ahead("n", [*KEY, "place", "part"], ["doc_id", "text_hash", "size"]).alias("within"))
    rows = rows.join(parts, [*KEY, "place", "part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5("source_key"), 1, 5), 16, 10).cast("double") / (1 << 20)
    before = F.col("cell_before") + F.col("part_before") + F.col("within")
    columns = ("doc_id", "text_hash", "size", "source_key", "source_size", "target", rate.alias("rate"), offset.alias("offset"), "n", before.alias("before"))
    found = durable(rows.select(*columns), "mixing-ranks")
    discard(sums)
    return found


def crossed(first: str, last: str) -> Column:
    """Whole numbers that the running sum crosses from before the rank `first` + 1 to the rank `last`."""
    return F.expr(f"CAST(floor(({last}) * rate + offset) - floor(({first}) * rate + offset) AS LONG)")


def sample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, text_hash, size, source_key, source_size, target, copies: one row for each row of `docs` (doc_id, text, source)."""
    rows = dealt(ranked(docs, weights, most))
    return rows.select("doc_id", "text_hash", "size", "source_key", "source_size", "target", crossed("before + k", "before + k + 1").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of `docs`."""
    return sample(docs, weights, most).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`docs` with each row as often as the mix takes it."""
    key = ["doc_id", "text_hash", "source_key"]
    copies = ranked(docs, weights, most).select(*key, crossed("before", "before + n").alias("copies_taken")).where("copies_taken > 0")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), source_key(F.col("source")).alias("source_key"))
    rows = rows.groupBy(*key).agg(F.first("row").alias("row"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    joined = rows.alias("r").join(copies.alias("c"), same)
    return joined.select("row", F.explode(F.expr("sequence(1L, copies_taken)"))).select("row.*")
