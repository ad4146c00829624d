import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickstrata.llm import ngram_join as N
from tickstrata.llm import queries


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(rows, n, num, den):
    """(n_shingles, component) of each doc_id, by comparing all pairs that share an n-gram."""
    sets = [(d, grams(t, n)) for d, t in rows]
    having, parent = defaultdict(list), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, s) in enumerate(sets):
        for e, c in Counter(e for g in s for e in having[g]).items():
            if den * c >= num * (len(s) + len(sets[e][1]) - c):
                parent[max(find(k), find(e))] = min(find(k), find(e))
        for g in s:
            having[g].append(k)
    low = {}
    for k, (d, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), d), d)
    return sorted((d, len(s), low[find(k)] if s else d) for k, (d, s) in enumerate(sets))


def corpus(rng, count):
    words = ["w%d" % i for i in range(400)]
    rows, texts = [], []
    for _ in range(count):
        if texts and rng.random() < 0.7:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[: max(1, len(t) - rng.randint(0, 6))]
        else:
            t = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 30, 80, 200]))]
        texts.append(" ".join(t))
        rows.append((len(rows), texts[-1]))
    return rows


@pytest.mark.parametrize(("n", "num", "den", "block"), [(3, 9, 10, 1 << 20), (5, 8, 10, 1 << 20), (3, 8, 10, 400)])
def test_matches_brute_force(spark, n, num, den, block):
    rows = corpus(random.Random(n + block), 400)
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "One Two"), (404, "one  two"), (405, rows[0][1]), (405, rows[0][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, signatures string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.classes(df, n, num, den, block).collect())
    assert got == brute(rows, n, num, den)


def test_trie_alone_matches_brute_force():
    rng = random.Random(5)
    rows = [r for r in dict((t, (d, t)) for d, t in corpus(rng, 300)).values()]
    sets = {}
    for d, t in rows:
        sets.setdefault(N.node_of(N.shingles(t, 3)), (d, t))
    order = sorted(sets.values(), key=lambda r: len(grams(r[1], 3)))
    trie = N.Trie(9, 10)
    for _, t in order:
        trie.add(N.shingles(t, 3))
    want = {d: c for d, _, c in brute(order, 3, 9, 10)}
    got = defaultdict(set)
    for k, (d, _) in enumerate(order):
        got[trie.find(k)].add(d)
    assert sorted(map(sorted, got.values())) == sorted(sorted(d for d in want if want[d] == c) for c in set(want.values()))


def test_many_near_copies_take_few_visits():
    rng = random.Random(1)
    base = ["w%d" % rng.randrange(9999) for _ in range(150)]
    trie, nodes = N.Trie(9, 10), set()
    for _ in range(1500):
        t = list(base)
        t[rng.randrange(150)] = "x%d" % rng.randrange(9999)
        x = N.shingles(" ".join(t), 3)
        if (node := N.node_of(x)) not in nodes:
            nodes.add(node)
            trie.add(x)
    assert len({trie.find(k) for k in range(len(nodes))}) == 1
    assert trie.visits < 60 * len(nodes)


def test_linked_sets_share_as_many_digests_as_promised():
    """Whatever their size and wherever they differ, in a scheme that both have."""
    rng, bands = np.random.default_rng(2), N.Bands(8, 10)
    for n in [*range(1, 60), 100, 333, 1000]:
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for _ in range(5):
            drop = int(rng.integers(0, n // 9 + 1))
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if (len(x) != len(y) or (x != y).any()) and 10 * both >= 8 * (len(x) + len(y) - both):
                own, other = ({k: (margin, set(s)) for k, margin, s in bands.signatures(z)} for z in (x, y))
                shared = [(k, len(own[k][1] & other[k][1])) for k in own.keys() & other.keys()]
                assert any(c >= max(own[k][0], other[k][0]) for k, c in shared), (n, drop)


def test_one_of_each(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "other words that stand alone here"), (2, "other words that stand alone here"), (5, None), (6, ""), (7, "x"), (None, "x")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, copies int")
    got = N.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [(1, "A b c d e f g"), (2, "other words that stand alone here"), (5, None), (7, "x")]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.classes(df).count() == 0 and N.one_of_each(df).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op10_ngram_join(spark, sf_dir).collect())
    assert got == brute(rows, 3, 9, 10)


def test_a_group_of_many_blocks_is_not_compared_block_by_block(spark, monkeypatch):
    """Near copies by the hundred: each goes to one trie, and few of them to another one."""
    rng, went = random.Random(9), []
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    rows = [(k, f"{base} own{k}") for k in range(600)]
    links = N._Linker.links

    def counted(self, tries):
        went.append(tries.selectExpr("sum(size(members)) AS n").first().n or 0)
        return links(self, tries)

    monkeypatch.setattr(N._Linker, "links", counted)
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"), block=3000).collect()  # 20 blocks
    assert len(got) == 600 and {r.component_id for r in got} == {0}
    assert went[0] == 600 and sum(went) < 1000, went


def test_a_passage_that_many_share_makes_no_large_group(spark, monkeypatch):
    """Two thirds of each text are the same passage, which links none of them; only the few near copies go to tries."""
    rng, went = random.Random(10), []
    words = lambda count: [f"w{rng.randrange(10**6)}" for _ in range(count)]
    passage = words(100)
    texts = [passage + words(45) for _ in range(180)]
    texts += [t[:-1] + words(1) for t in texts[:20]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    links = N._Linker.links

    def counted(self, tries):
        went.append(tries.selectExpr("sum(size(members)) AS n").first().n or 0)
        return links(self, tries)

    monkeypatch.setattr(N._Linker, "links", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.classes(df, 5, 8, 10, block=3000).collect())
    assert got == brute(rows, 5, 8, 10)
    assert sum(went) == 40, went


def test_components_take_few_turns_and_broadcast_nothing(spark, monkeypatch, tmp_path):
    """Stars are done after one turn, a path of 60 after a few; the driver gets no broadcast of nodes, however few they are."""
    plans, durable = [], N.durable

    def kept(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df, name)

    monkeypatch.setattr(N, "durable", kept)
    for name, rows, most in (("stars", [(k, k % 3) for k in range(3, 50)], 1), ("path", [(k, k + 1) for k in range(60)] + [(7, 7), (1, 0)], 6)):
        plans.clear()
        spark.createDataFrame(rows, "a long, b long").write.parquet(f"{tmp_path}/{name}")
        got = sorted((r.node, r.root) for r in N.components(spark.read.parquet(f"{tmp_path}/{name}")).collect())
        assert got == ([(k, k % 3) for k in range(3, 50)] if name == "stars" else [(k, 0) for k in range(1, 61)])
        assert len(plans) <= most, (name, len(plans))
        assert not any("Broadcast" in p for p in plans)


def test_digests_are_joined_in_parts(spark, monkeypatch):
    """The join of the digests is written in parts, none of which has most of the rows; together they lose no link."""
    rows, sizes, durable = corpus(random.Random(11), 200), [], N.durable

    def kept(df, name="table"):
        out = durable(df, name)
        if name == "ngram-shared":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(N, "durable", kept)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 3, 9, 10)
    assert len(sizes) == N.PASSES and max(sizes) < 0.6 * sum(sizes), sizes


@pytest.mark.parametrize("most", [0, 40, N.EDGES])
def test_components_of_a_small_graph_take_one_task(spark, monkeypatch, tmp_path, most):
    """A graph of at most EDGES edges is written once, without a shuffle; a larger one is contracted, to its end or until it is small. The components are the same."""
    rng, plans, durable = random.Random(12), [], N.durable

    def kept(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df, name)

    monkeypatch.setattr(N, "durable", kept)
    monkeypatch.setattr(N, "EDGES", most)
    path = [(k, k + 1) for k in range(60)]
    rows = [*path, (7, 7), (1, 0), *((k, 1000) for k in range(100, 160)), *((rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)), (-5, -9)]
    low = {x: x for e in rows for x in e}
    while any(low[a] != low[b] for a, b in rows):
        for a, b in rows:
            low[a] = low[b] = min(low[a], low[b])
    for name, some in (("none", []), ("path", path), ("all", rows)):
        plans.clear()
        spark.createDataFrame(some, "a long, b long").write.parquet(f"{tmp_path}/{name}")
        got = sorted((r.node, r.root) for r in N.components(spark.read.parquet(f"{tmp_path}/{name}")).collect())
        nodes = {x for e in some for x in e}
        assert got == sorted((x, r) for x, r in low.items() if x in nodes and x != r)
        shuffled = ["Exchange" in p for p in plans]
        assert shuffled == [False] if len(some) <= most else shuffled[0], (name, shuffled)
