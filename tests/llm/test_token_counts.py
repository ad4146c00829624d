import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickstrata.llm import token_counts as T

ROWS = [(1, "A short text."), (2, None), (3, ""), (4, "A short text."), (4, "A short text."), (5, "Ünïcode 漢字 😀 <s> </s> <|endoftext|>\n\n\ttail "), (6, "long " * 5000), (None, "x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, 0, b"") for d, t in rows], "doc_id long, text string, n_tokens int, digest binary")


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_are_the_librarys(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    want = [(d, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for d, t in ROWS]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in T.count_tokens(frame(spark), path).collect())


def test_the_cache_grows_by_distinct_misses_only(spark, tmp_path):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    size = lambda: spark.read.parquet(cache).count()
    T.count_tokens(frame(spark), path, cache)
    assert size() == len({t or "" for _, t in ROWS})
    T.count_tokens(frame(spark, [*ROWS, (9, "new"), (8, "new")]), path, cache)
    assert size() == len({t or "" for _, t in ROWS}) + 1
    other = public_tokenizers.path("byte_bpe_50k.json")  # another tokenizer doesn't read these counts
    T.count_tokens(frame(spark), other, cache)
    assert size() == 2 * len({t or "" for _, t in ROWS}) + 1


def test_counts_come_from_the_cache(spark, tmp_path):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    T.count_tokens(frame(spark), path, cache)
    planted = spark.read.parquet(cache).selectExpr("digest", "tokenizer", "n_tokens + 100000 AS n_tokens")
    planted.write.parquet(f"file://{tmp_path}/planted")
    got = T.count_tokens(frame(spark), path, f"file://{tmp_path}/planted").collect()
    assert all(r.n_tokens >= 100000 and r.over_limit for r in got) and len(got) == len(ROWS)


def test_empty_table(spark):
    assert T.count_tokens(frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_query_counts_the_whole_table(spark, sf_dir):
    from tickstrata.llm import queries

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(d, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for d, t in texts]
    got = queries.op2_token_counts(spark, sf_dir).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, got)) == sorted(want)
