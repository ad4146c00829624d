"""Each stage of the pipeline on what its predecessor kept, against a plain version."""

import random
from collections import Counter

import pytest
import test_line_dedup
import test_ngram_join
import test_packing

import corpus_pipeline as C
from tickstrata.llm import mixing, quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows before and after each stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out[name] = docs, after
        docs = after
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(stages):
    assert [name for name, _ in C.STAGES] == ["quality", "line dedup", "near duplicates", "mixing", "packing"]
    for name in ("quality", "line dedup", "near duplicates", "mixing"):
        assert stages[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, sf_dir, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(before, labels)
    want = [r for r in before.collect() if model.tails([r.text])[0, 1] >= 0.5]
    assert sorted(after.collect()) == sorted(want)
    clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    assert len(clean & {r.doc_id for r in want}) >= 0.97 * len(clean)


def test_lines(stages):
    before, after = stages["line dedup"]
    assert texts(after) == [(d, t) for d, t, _ in test_line_dedup.brute(texts(before), C.COPY)]
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicates(stages):
    before, after = stages["near duplicates"]
    want = test_ngram_join.brute(texts(before), 5, 8, 10)
    assert [d for d, _ in texts(after)] == [d for d, _, c in want if d == c]


def test_mixing(stages):
    before, after = stages["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.sample(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == copies
    assert set(texts(after)) <= set(texts(before))


def test_packing_stage(stages):
    before, after = stages["packing"]
    test_packing.check(after.collect(), texts(before))


def test_run(spark, sf_dir, stages):
    got = C.run(spark, sf_dir).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, stages["packing"][1].collect()))


def test_repeated_runs_are_gone_before_mixing(spark, stages):
    before, after = stages["near duplicates"]
    kept = {r.doc_id for r in after.collect()}
    want = test_line_dedup.brute([x for x in texts(before) if x[0] in kept])
    assert texts(after) == [(d, t) for d, t, _ in want]
    assert any(n for *_, n in want)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_odd_documents_go_through_all_stages(spark, sf_dir, tmp_path):
    """Nulls in every column, empty, repeated and very long texts, and columns whose names the stages use themselves."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(n))
    rows = [(k, text(60), "en", "s", 1) for k in range(20)] + [(30, text(30_000), "en", "s", 1)]
    rows += [(None, None, None, None, None), (21, None, "en", None, 0), (22, "", None, "s", 0), (23, "", "en", "s", 0), *[rows[3]] * 3, (24, rows[4][1], "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.selectExpr("*", "1 AS text_hash", "2 AS `row`", "3 AS gone", "4 AS node", "5 AS copies", "6 AS size")
    for k, (_, stage) in enumerate(C.STAGES[1:]):
        for rows_in in (docs, docs.limit(0)):
            out = stage(spark, rows_in, sf_dir)
            assert k == 3 or out.columns == docs.columns
            out.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            if rows_in is not docs:
                assert spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}").count() == 0
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}")
        if k == 1:
            left = [(r.doc_id, r.text) for r in docs.collect()]
            assert sum(not t for _, t in left) == 1 and len(left) == len(set(left)) == 22
    assert docs.count()
    quality_out = C.classify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), sf_dir)
    assert quality_out.count() <= len(rows)
