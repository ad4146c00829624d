import hashlib
import random
import re

from tickstrata.llm import line_dedup as L


def words(lines):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]


def spans(lines):
    """First and last line of the chunks of several lines, and of every run of 50 words or more."""
    rolled, n = [int(hashlib.md5(x.encode()).hexdigest()[:4], 16) for x in lines], words(lines)
    out, first = set(), 0
    for i in range(len(lines)):
        if i + 1 == len(lines) or ((rolled[i - 1] if i else 0) * 31 + rolled[i]) % 101 % 2 == 0:
            if i > first:
                out.add((first, i))
            first = i + 1
    for a in range(len(lines)):
        total = 0
        for b in range(a, len(lines)):
            total += max(n[b], 1)
            if total >= 50:
                out.add((a, b))
    return sorted((a, b) for a, b in out if any(n[a : b + 1]))


def brute(rows, whole=None):
    """Chunks, and all runs of 50 words or more, that stand earlier."""
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out.append((d, None, 0))
            continue
        lines, gone = t.split("\n"), set()
        for a, b in spans(lines):
            e, end = first.setdefault(tuple(lines[a : b + 1]), (d, b))
            if e != d or end < a:
                gone |= set(range(a, b + 1))
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((d, left, len(gone)) if gone and (whole is None or len(left) > (1 - whole) * len(t)) else (d, t, 0))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, [2]) for d, t in rows], "doc_id long, text string, k int, chunks array<int>")


def test_matches_brute_force(spark):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 6, 8, 20, 60]))) for _ in range(40)] + ["", "é😀 " * 30]
    rows = []
    for i in range(250):
        own = [f"only {i} {j} here in this one" for j in range(rng.randint(0, 3))]
        at = rng.randrange(len(lines))
        rows.append((i, "\n".join(own + lines[at : at + rng.randint(1, 9)] + own[::-1])))
    rows += [(900, None), (901, ""), (902, "\n\n\n"), (903, rows[5][1]), (904, "a " * 30_000), (905, "\n\n\n")]
    got = L.clean(frame(spark, [*rows, (910, "x\n" * 20_000)]).repartition(4))
    assert got.columns == ["doc_id", "text", "k", "chunks", "n_lines", "n_removed"]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in got.collect())
    assert got[:-1] == brute(rows)
    assert got[-1][1] == "x\n" * 50  # one run of equal lines: what overlaps the first 50 stays, and the end
    whole = L.clean(frame(spark, rows), whole=0.3).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in whole) == brute(rows, 0.3)


def test_a_passage_shared_by_very_many_documents_stays_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    got = L.clean(frame(spark, [(i, f"own line {i}\n{passage}\nend of {i}") for i in range(3000)])).collect()
    assert [r.doc_id for r in got if passage in r.text] == [0]
    assert all(f"own line {r.doc_id}\n" in r.text and r.text.endswith(f"end of {r.doc_id}") for r in got)


def test_short_single_lines_and_repeated_rows_stay(spark):
    rows = [(i, f"text number {i}\nAll rights reserved.") for i in range(50)] + [(60, "a b c d e f\ng h i j k l m n")] * 3
    got = L.clean(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)


def test_a_null_doc_id_comes_first(spark):
    long = "w " * 60 + "end"
    got = L.clean(frame(spark, [(None, long), (1, long), (2, long)])).collect()
    assert {r.doc_id: r.text for r in got} == {None: long, 1: "", 2: ""}


def test_empty_table(spark):
    assert L.clean(frame(spark, [])).count() == 0


def test_every_repeated_run_of_50_words_goes(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(str(rng.random()) for _ in range(n))
    rows = []
    for n in range(1, 11):
        for words in (5, 9, 20, 30, 49, 50):
            passage = [line(words) for _ in range(n)]
            for _ in range(3):
                rows.append((len(rows), "\n".join([line(9)] * rng.randint(0, 2) + passage + [line(9)] * rng.randint(0, 2))))
    rows += [(500 + n, "\n".join(["a b c d e f g h i " * 2 + str(n)] * n)) for n in range(1, 12)] + [(600, "x y\n" * 3000), (601, ""), (602, "q " * 3000)]
    got = {r.doc_id: r for r in L.clean(frame(spark, rows).repartition(4)).collect()}
    assert sorted((d, r.text, r.n_removed) for d, r in got.items()) == brute(rows)
    # passages of 50 words or more between different neighbours: one of three copies stays, in the first document
    for n in range(1, 11):
        for k, size in enumerate((5, 9, 20, 30, 49, 50)):
            if n * size >= 50:
                three = [got[((n - 1) * 6 + k) * 3 + j] for j in range(3)]
                assert [r.n_removed for r in three] == [0, n, n]


def test_columns_with_clashing_names(spark):
    long = "w " * 60
    df = spark.createDataFrame([(1, long, "a", 1), (2, long, "b", 2)], "doc_id long, text string, text_hash string, gone int")
    got = L.clean(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, long, "a", 1, 1, 0), (2, "", "b", 2, 1, 1)]
