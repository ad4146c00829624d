import hashlib
import random

from tickstrata.llm import exact_dedup as D


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = set()
        for d in ids:
            out.append((d, keep, len(ids), d == keep and d not in seen, hashlib.sha256(norm.encode()).hexdigest()))
            seen.add(d)
    return sorted(map(repr, out))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, b"x") for d, t in rows], "doc_id long, text string, content binary").repartition(5)
    return sorted(repr(tuple(r)) for r in D.mark(df, **kw).collect())


def test_matches_brute_force_within_memory_and_spilling(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é\nÉ") for _ in range(rng.randint(0, 6))) for _ in range(300)] + ["y" * 50_000, "Y" * 50_000, "y" * 49_999 + "z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(999, None), (998, ""), (None, "ab"), (None, None), (5, texts[5]), (5, texts[5])]
    rows += [(10_000 + i, "a text that very many rows share") for i in range(500)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, budget=2_000) == brute(rows)  # every table outgrows its memory several times over


def test_partitions_until_a_bucket_fits():
    records = [(D._hash(c), c, k, 1) for k, c in enumerate(str(i % 3000).encode() * 9 for i in range(9000))]
    got = {r[1]: (r[2], r[3]) for r in D.grace(iter(records), 20_000)}
    assert got == {str(i).encode() * 9: (6000 + i, 3) for i in range(3000)}


def test_equal_hashes_are_not_equal_contents():
    got = sorted(tuple(r[1:]) for r in D.grace(iter([(7, b"a", 1, 1), (7, b"b", 2, 1), (7, b"a", 3, 1)]), 1))
    assert got == [(b"a", 3, 2), (b"b", 2, 1)]


def test_empty_table(spark):
    assert D.mark(spark.createDataFrame([], "doc_id long, text string")).count() == 0
