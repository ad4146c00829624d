"""Document fingerprints from closed syncmers.

The units of a text are its words (a run of more than LONGEST characters counts as so many single ones). A
k-mer of five units is an anchor if the smallest hash among its inner pairs of units is its first or its
last one. That depends on the k-mer alone, so an anchor that two texts share is chosen in both, wherever
it stands. A fingerprint has all distinct anchors, each with the place (in units) where it stands first;
it grows with the text.

Fingerprints are matched by place: anchors of equal hash are matches, and a match counts if the one
before or after it has the same distance between its two places, so that at least two anchors
agree on where a passage stands. The likeness is the number of those matches over that of all different
anchors of both: about the Jaccard index of the texts' five-word shingles. Half of the k-mers are anchors, so for n shingles in
both together its standard error is about sqrt(j * (1 - j) * 2 / n).

Defined cases: a null text counts as empty and has an empty fingerprint; a text without any anchor
has one for all its units; equal fingerprints, empty ones too, have likeness 1, an empty and another one 0;
documents of equal doc_id stand in the order of their texts' hashes; a null doc_id comes last; the
next document of the only one is itself; very long texts have longer fingerprints, made and matched in
n log n time; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONGEST = 48
UNIT = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{1,{LONGEST}}}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
K = 5
RANGES = 8  # of doc_id, for each shuffle partition
PLACE = (1 << 32) - 1  # an anchor is hash << 32 | place
OTHER = 1 << 31  # marks the anchors of the second fingerprint


def _staged(df: DataFrame, text: str) -> DataFrame:
    """`df` with the hashes of the units (_h) and of the pairs of neighbouring units (_s)."""
    df = df.select("*", F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u)).alias("_h"))
    return df.select("*", F.transform("_h", lambda x, i: F.xxhash64(x, F.get("_h", i + 1))).alias("_s"))


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(~PLACE).bitwiseOR(place.cast("long"))


def _anchor(x: Column, i: Column) -> Column:
    """The k-mer at i, packed, if it is an anchor, or null; x is its first inner pair's hash."""
    edge = F.least(x, F.get("_s", i + 3))
    inner = F.least(F.get("_s", i + 1), F.get("_s", i + 2))
    value = _packed(F.xxhash64(x, F.get("_s", i + 2), F.get("_h", i + 4)), i)
    return F.when((i <= F.size("_h") - K) & (edge <= inner), value)


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the column `name`: the distinct anchors of the column `text`, packed, by hash."""
    df = _staged(df, text)
    whole = F.array(_packed(F.aggregate("_h", F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)), F.lit(0)))
    df = df.select("*", F.sort_array(F.array_compact(F.transform("_s", _anchor))).alias("_a"))
    distinct = F.filter("_a", lambda x, i: (i == 0) | (_hash(x) != _hash(F.get("_a", i - 1))))
    some = F.when(F.size("_a") > 0, distinct).when(F.size("_h") > 0, whole).otherwise(F.array().cast("array<long>"))
    return df.withColumn(name, some).drop("_h", "_s", "_a")


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """`df` with the column `name`: the likeness of the fingerprints `a` and `b`."""
    place = lambda x: x.bitwiseAND(OTHER - 1)
    df = df.select("*", F.sort_array(F.concat(F.col(a), F.transform(b, lambda x: x.bitwiseOR(OTHER)))).alias("_both"))
    both = lambda x, i: F.when(_hash(x) == _hash(F.get("_both", i + 1)), F.shiftleft(place(x), 32).bitwiseOR(place(F.get("_both", i + 1))))
    df = df.select("*", F.sort_array(F.array_compact(F.transform("_both", both))).alias("_met"))
    apart = lambda m: F.shiftright(m, 32) - m.bitwiseAND(PLACE)
    beside = lambda m, i: F.coalesce(apart(m) == apart(F.get("_met", i)), F.lit(False))
    held = F.size(F.filter("_met", lambda m, i: beside(m, i - 1) | beside(m, i + 1)))
    df = df.withColumn("_held", held)
    value = F.when(F.col(a) == F.col(b), 1.0).otherwise(F.col("_held") / (F.size("_both") - F.col("_held")))
    return df.withColumn(name, value).drop("_both", "_met", "_held")


def text_of(name: str) -> Column:
    """hash.place of the anchors, by place."""
    turned = F.sort_array(F.transform(name, lambda x: F.shiftleft(x.bitwiseAND(PLACE), 32).bitwiseOR(F.shiftrightunsigned(x, 32))))
    return F.array_join(F.transform(turned, lambda x: F.concat_ws(".", F.lower(F.hex(x.bitwiseAND(PLACE))), F.shiftright(x, 32).cast("string"))), " ")


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows that the driver knows: at most one for each range."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` (doc_id, text, ...) with next_<column>: its values in the next document, by descending doc_id.

    Documents go to ranges of doc_id, a few for each shuffle partition. The largest document of each
    range goes to the range above, too (of the highest to the lowest one), where it stands last and
    only serves as the next of the one before it. So a range never needs to see another one. A row finds its
    range in two steps, among the first cuts of groups and then in a group, each of about the root of their number.
    """
    spark = df.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select("doc_id")
    shares = F.split(F.lit(",".join(str(k / n) for k in range(1, n))), ",").cast("array<double>")  # one literal
    cuts = ids.agg(F.percentile_approx("doc_id", shares, 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    wide = math.isqrt(len(cuts)) + 1
    groups = [cuts[k : k + wide] for k in range(0, len(cuts), wide)]
    array = F.array(*(F.lit(g[0]) for g in groups)) if groups else F.array().cast("array<long>")
    ranges = _small(spark, [{"g": k + 1, "cuts": g} for k, g in enumerate(groups)], "g int, cuts array<long>")
    group = F.size(F.filter(array, lambda c: c <= F.col("doc_id")))
    within = lambda d: d.join(F.broadcast(ranges), group == F.col("g"), "left").withColumn(
        "bucket", F.coalesce((F.col("g") - 1) * wide + F.size(F.filter("cuts", lambda c: c <= F.col("doc_id"))), F.lit(0))
    ).drop("g", "cuts")
    heads = sorted((r["bucket"], r["head"]) for r in within(ids).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    above = [b for b, _ in heads[1:]] + [b for b, _ in heads[:1]]
    to = _small(spark, [{"head": head, "to": b} for (_, head), b in zip(heads, above, strict=True)], "head long, to int").distinct()
    df = within(df).join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    both = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("copy")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("copy")))))
    df = df.select(*(c for c in df.columns if c not in ("bucket", "head", "to")), F.explode(both).alias("at")).select("*", "at.*").drop("at")
    order = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return df.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("NOT copy").drop("bucket", "copy")


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of `docs`.

    The edited text has the last half of its code points replaced by the first as many of the next document.
    """
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    df = _with_next(fingerprint(df, "text", "own"), ["text", "own"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    df = df.select("doc_id", "own", "next_own", F.length("text").cast("long").alias("n_chars"), edited.alias("edited_text"))
    df = with_likeness(df, "own", "next_own", "near_next").drop("next_own")
    df = with_likeness(fingerprint(df, "edited_text", "edited"), "own", "edited", "near_edited")
    return df.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), text_of("own").alias("fingerprint"), text_of("edited").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
