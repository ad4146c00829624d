import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickstrata.llm import packing as K

PATH = public_tokenizers.path("byte_bpe_50k.json")


OWN = Tokenizer.from_file(PATH)


def ids_of(text):
    return OWN.encode(text or "", add_special_tokens=False).ids + [0]


def check(got, rows):
    """Every piece of every row once, none beyond its sequence, no gaps."""
    want = []
    for d, t in rows:
        ids = np.array(ids_of(t), "<u4")
        start, end, k = 0, len(ids) % K.SIZE or min(K.SIZE, len(ids)), 0
        while start < len(ids):
            want.append((d, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, end, k = end, end + K.SIZE, k + 1
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= K.SIZE
    return len(bins)


def test_both_encoders_agree():
    """Wherever tiktoken is used, its ids are those of tokenizers."""
    encode, rng = K._encoder(PATH), random.Random(3)
    chars = [chr(c) for c in range(1, 0x250)]
    texts = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(1500)]
    texts += ["".join(rng.choice("ab é'\n\t  .,!1²½ßtsrevmld") for _ in range(60)) for _ in range(1500)]
    texts += [a + " " * n + b for a in ("", "x", "\n", "'s") for b in ("", "y", "\n", ".", "1") for n in range(5)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>b", "漢字😀", "x" * 5000, "\n" * 5000, "a" + "." * 5000]
    for t in texts:
        assert encode(t).tolist() == ids_of(t)[:-1], repr(t)


def test_packs_every_piece(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "tion", "x1"]) for _ in range(rng.choice([0, 1, 30, 400, 900, 2500])))) for i in range(150)]
    rows += [(500, None), (500, None), (None, "no id"), (501, "w " * 2047), (502, "w " * 2048), (503, "w " * 9000), (504, "<|endoftext|> 漢字")]
    df = spark.createDataFrame([(d, t, 0, 1) for d, t in rows], "doc_id long, text string, block int, piece int").repartition(3)
    got = K.pack_documents(df, PATH).collect()
    bins = check(got, rows)
    assert bins <= len(K.start([r.length for r in got], K.SIZE, rng, 0.0).bins)  # no more than best-fit takes
    again = K.pack_documents(df.repartition(5), PATH).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    cut = K.pieces(df, PATH)
    assert check(K.pack(cut, per_block=40).collect(), rows) >= bins  # several blocks


def test_the_genetic_step_saves_bins():
    """Sizes that pack into full bins exactly, which best-fit on a descending order misses."""
    rng, sizes = random.Random(5), []
    for _ in range(60):
        a, b = rng.randint(300, 900), rng.randint(300, 900)
        sizes += [a, b, K.SIZE - a - b]
    greedy = K.start(sizes, K.SIZE, rng, 0.0)
    best = K.evolve(sizes, K.SIZE, "t", [], generations=400)
    assert len(best.bins) <= len(greedy.bins) and best.score > greedy.score
    assert sorted(k for b in best.bins for k in b) == list(range(len(sizes)))


def test_registered_settings_save_bins_against_best_fit(spark):
    """Blocks as the query evolves them: islands, rounds and generations are the defaults."""
    rng, saved = random.Random(11), []
    for n in (20, 60, 200):
        sizes = []
        for _ in range(n):
            a, b = rng.randint(300, 900), rng.randint(300, 900)
            sizes += [a, b, K.SIZE - a - b]
        cut = spark.createDataFrame([(k, 0, 0, x, k) for k, x in enumerate(sizes)], K.PIECE)
        got = K.pack(cut).collect()
        bins = {}
        for r in got:
            bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
        assert len(got) == len(sizes) and max(bins.values()) <= K.SIZE
        saved.append(len(K.start(sizes, K.SIZE, rng, 0.0).bins) - len(bins))
    assert min(saved) >= 0 and saved[1] >= 1 and saved[2] >= 2, saved


def test_exchange_fills_bins():
    rng = random.Random(12)
    sizes = [rng.randint(1, 900) for _ in range(300)]
    bins, fill = [[k, k + 1] for k in range(0, 200, 2)], [sizes[k] + sizes[k + 1] for k in range(0, 200, 2)]
    before, free = list(fill), list(range(200, 300))
    left = K.exchange(bins, fill, free, sizes, 1800, list(range(100)))
    assert all(b <= f <= 1800 for b, f in zip(before, fill)) and sum(fill) > sum(before)
    assert fill == [sum(sizes[x] for x in b) for b in bins]
    assert sorted([x for b in bins for x in b] + left) == list(range(300))


def test_crossover_keeps_each_piece_once():
    rng = random.Random(6)
    sizes = [rng.randint(1, K.SIZE) for _ in range(500)]
    a, b = K.start(sizes, K.SIZE, rng, 0.5), K.start(sizes, K.SIZE, rng, 1.0)
    for _ in range(20):
        child = K.cross(a, b, sizes, K.SIZE, rng)
        assert sorted(k for x in child.bins for k in x) == list(range(500)) and max(child.fill) <= K.SIZE
        a, b = child, a


def test_elites_migrate():
    """An island that gets a better packing goes on from it."""
    rng = random.Random(7)
    sizes = [rng.randint(1, 900) for _ in range(200)]
    elite = K.evolve(sizes, K.SIZE, "a", [], generations=200)
    assert K.evolve(sizes, K.SIZE, "b", [elite], generations=1).score >= elite.score


def test_empty_table(spark):
    assert K.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("name", ["op7_packing"])
def test_query(spark, sf_dir, name):
    from tickstrata.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(queries.QUERIES[name](spark, sf_dir).collect(), rows)
