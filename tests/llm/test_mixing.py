import hashlib
import random

import pytest

from tickstrata.llm import mixing as M


def level(sizes, weights, most):
    """Targets by filling up step by step."""
    total, names = sum(sizes.values()), sorted(sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped = set()
    while True:
        free = [n for n in names if n not in capped]
        rest = total - sum(most * sizes[n] for n in capped)
        share = {n: rest * w[n] / sum(w[x] for x in free) for n in free}
        over = {n for n in free if share[n] > most * sizes[n] + 1e-9}
        if not over:
            return {n: float(most * sizes[n]) if n in capped else share[n] for n in names}
        capped |= over


def test_targets(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = {f"0s{i}": rng.choice([0, 1, 10, 100, 1000, 10_000]) + rng.randint(0, 5) for i in range(rng.randint(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source_key string, size long")
        got = {r.source_key: r.target for r in M.targets(df).collect()}
        if sum(sizes.values()):
            assert got == pytest.approx(level(sizes, M.WEIGHTS, M.MOST))


def documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 50, 300])), rng.choice(["a", "a", "a", "b", "é", None, "B"]), i) for i in range(3000)]
    rows += [(9000 + i, "same text here", "hot", 0) for i in range(2000)] + [(7, None, "a", 0), (7, None, "a", 0), (None, "x y", "only", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, text_hash long")


def test_words_come_near_the_targets_and_reruns_agree(spark):
    docs = documents(spark)
    first, again = M.mix(docs.repartition(3)).collect(), M.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and len(first) == 5003
    taken, target = {}, {}
    for r in first:
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        key = (r.source_size, r.target)
        taken[key], target[key] = taken.get(key, 0) + r.taken, r.target
    for key, n in taken.items():
        assert abs(n - target[key]) <= max(600, 0.03 * target[key]), key
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in first))


def test_each_document_is_taken_once_for_each_boundary(spark):
    rows = M.sample(spark.createDataFrame([(i, "a b c", s) for i in range(400) for s in ("x", "y", "z")], "doc_id long, text string, source string")).collect()
    for key in {r.source_key for r in rows}:
        own = [r for r in rows if r.source_key == key]
        rate = own[0].target / own[0].source_size
        assert {r.copies for r in own} <= {int(rate), int(rate) + 1}
        assert abs(sum(r.copies for r in own) - 400 * rate) <= 1


def test_resample_repeats_whole_rows(spark):
    docs = documents(spark)
    want = {}
    for r in M.sample(docs).collect():
        want[(r.doc_id, r.source_key)] = want.get((r.doc_id, r.source_key), 0) + r.copies
    out = M.resample(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        key = (r.doc_id, "1" if r.source is None else "0" + r.source)
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0 and M.resample(df).count() == 0


def test_rows_of_one_id_are_ranked_in_parts(spark):
    """One doc_id, source and size class: copies as of a plain walk in the stated order, and no task with all rows."""
    rows = [(None, f"w{i} x y", "hot") for i in range(3000)] + [(5, "a b c", "hot")] * 500 + [(i, "a b c", "hot") for i in range(40)] + [(i, "a b", "other") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = M.ranked(docs).collect()
    assert sum(r.n for r in found) == len(rows) and len(found) == len(set(rows))
    hot = sorted((r.before, r.n) for r in found if r.source_key == "0hot")
    assert [b for b, _ in hot] == [sum(n for _, n in hot[:k]) for k in range(len(hot))]
    order = [r.doc_id for r in sorted(found, key=lambda r: r.before) if r.source_key == "0hot"]
    key = lambda d: hashlib.md5(b"" if d is None else str(d).encode()).hexdigest()
    assert order == sorted(order, key=key)
    assert len({r.text_hash >> M.PART for r in found if r.doc_id is None}) > 200
    taken = [r.copies for r in M.sample(docs).collect() if r.source_key == "0hot"]
    rate = next(r.rate for r in found if r.source_key == "0hot")
    assert len(taken) == 3540 and abs(sum(taken) - rate * 3540) <= 1 and set(taken) <= {int(rate), int(rate) + 1}
