"""The corpus pipeline: documents through quality, line dedup, near duplicates, mixing and packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and reread as the next stage's docs. All stages but the last return the columns
of documents. Near duplicates are judged on shingles of five words at a similarity of 0.8 or more. A copy that
lost its repeated lines would no longer resemble the document it copies, so line dedup leaves documents that would
lose COPY of their text to the near-duplicate stage, which takes the repeated lines of those that stay.

Defined cases: a null text counts as empty; of texts without words one stays; a row with its text and doc_id repeated
is one document from the near-duplicate stage on; texts of any length go through whole; stages keep the columns of
their docs, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstrata.llm import line_dedup, mixing, ngram_join, packing, quality
from tickstrata.session import durable, release, shared_dir

COPY = 0.2  # share of a text in repeated lines from which on the document is judged as a whole


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier gives the highest grade with probability 0.5 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated runs of lines out of the texts, but for copies as a whole; n_chars follows the text."""
    return _recounted(line_dedup.clean(docs, whole=COPY), docs)


def _recounted(cleaned: DataFrame, docs: DataFrame) -> DataFrame:
    """`cleaned` with the columns of `docs`, and n_chars of the texts that lines went from."""
    n_chars = F.when(cleaned["n_removed"] > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(cleaned["n_chars"])
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; of what those still share, repeated runs of lines go."""
    release(spark)
    kept = durable(ngram_join.one_of_each(docs, n=5, num=8, den=10), "near-kept")
    return _recounted(line_dedup.clean(kept), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", classify), ("line dedup", dedup_lines), ("near duplicates", drop_near), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None  # SQL can't express the classifier and the packing; tests/llm/test_pipeline.py checks each stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
