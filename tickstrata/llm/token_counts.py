"""Token counts through a digest cache.

A count depends on the content and on the tokenizer alone, so it is stored under the SHA-256 of the
content and a digest of the tokenizer's file. Counting joins the documents' digests to the cache,
encodes only the distinct contents that it misses, appends their counts, and joins the counts back.
The cache is a Parquet table in the shared folder: an append that fails leaves nothing half-written,
and rows that two jobs append twice are equal and count once.

The content is the text itself (null: empty): other normalisation would change what the tokenizer,
which normalises by its own rules, counts. Defined cases: empty texts have the count that the
library gives (0); repeated rows each get their row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstrata.llm.batches import slices
from tickstrata.session import shared_dir

_loaded: dict = {}
CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file never reads the counts of this one."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _counter(path: str):
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            _loaded[path] = lambda texts: [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    return _loaded[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in slices(batches):
            n = count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """digest, n_tokens: one row for each content counted with this tokenizer; a cache that isn't there yet is empty."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    rows = rows.where(F.col("tokenizer") == version)
    # grouped by more than the digest: a join on it then deals both sides itself, and can split a digest that many rows share
    return rows.groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).drop("tokenizer")


def fill_cache(docs: DataFrame, tokenizer: str, cache: str) -> None:
    """Encode the distinct contents of `docs` that the cache misses, and append their counts."""
    version = tokenizer_version(tokenizer)
    content = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    distinct = content.groupBy(F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(docs.sparkSession, cache, version), "digest", "left_anti")
    counted = misses.select("digest", "text").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs`.

    cache: path of the cache table; without one, a new cache in the shared folder serves this call alone.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    fill_cache(docs, tokenizer, cache)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    counts = read_cache(spark, cache, tokenizer_version(tokenizer))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
