"""N-gram Jaccard self-join with prefix trees.

Every document is a set of n-gram hashes in one global order, that of the hashes. Sets that are
equal are one node from the start. A trie stores the ordered sets of a group; a set that looks for
partners walks it, shares the overlap counted so far between all sets below a branch, and leaves a
subtree as soon as what remains there and in the set itself cannot reach the overlap needed. It also
leaves a subtree whose sets are all in its own component by now, so a group of k near copies costs
about k walks, not k * k comparisons. The tries are exact: every link between two components is found.

Which sets meet in a trie: the global order is cut into as many segments as two linked sets of a
size can have differences, plus a margin. Linked sets then agree on some whole segment. Sets that
share a segment's digest are joined to the smallest of them (but for common digests that a set can do without), the connected groups of this candidate
graph are found with distributed star contraction, and each group goes to a trie. Segments that are empty
on both sides need no digest: the margin leaves more segments with n-grams than differences; a set
for which that does not hold emits digests for its empty segments, too. A passage that very many documents
share chains them into one group, linked or not, and such groups grow with the corpus. So a group of more n-grams than
a block holds is grouped anew by the ends of its sets in an order of rarity (see _by_rarity), which leaves those
together that are nearly all passage. What is still larger than a block
is cut into blocks by hash, each with a trie of its own. Few members of what that has joined are dealt
to tries anew until nothing more is joined; then only the nodes outside the group's largest component meet all
the others, block by block. So a large group of near copies takes about a trie for each block; the work is quadratic
only in what stays outside the largest component.

Hashes have 64 bits; n-grams and sets are taken as equal if their hashes are.

Defined cases: a null text and a text without words have an empty set and are linked with nothing;
with fewer than n words the whole sequence is one n-gram; component_id is the smallest doc_id (null
only if all are null); rows of equal texts are in one component; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickstrata.llm.batches import slices
from tickstrata.session import discard, durable, release

U = np.uint64
BLOCK = 1 << 17  # n-grams in a block of a large group
MEMBERS = 4  # of a component, to look for links to others of its group
WORDS = 100_000  # whose hashes a worker keeps
PASSES = 2  # over the digests, each with a part of them: shuffle files of one part are there at a time
FEW = 4  # nodes that may share a digest before it counts as common
EDGES = 1 << 18  # of a graph whose components one task finds


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class _Words(dict):
    """Hashes of words; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct n-gram hashes of a text, ascending."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    if not len(h):
        return h
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, U(k))
    for i in range(k):
        total = _mix(total * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(total)


def node_of(x: np.ndarray) -> int:
    """A set's own 64-bit digest; 0 for the empty set."""
    if not len(x):
        return 0
    m = _mix(x + U(0x51ED270B))
    both = np.array([m.sum(dtype=U), np.bitwise_xor.reduce(m), len(x)], U)
    return int(_mix(_mix(both * np.array([3, 5, 7], U)).sum(dtype=U, keepdims=True))[0]) >> 1


class Bands:
    """Size bands of the ratio of the threshold num / den: linked sets are in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.low = num, den, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(self.low[-1] * den // num + 1)

    def schemes(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(band of the smaller set, most differences, segments) for a set of n: as the smaller and as the larger one."""
        band = bisect_right(self.low, n) - 1
        for k in (band, band - 1):
            if k >= 0 and (most := (self.low[k + 1] - 1) * (self.den - self.num) // self.num):
                yield k, most, most + most // 8 + 2

    def signatures(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(band, margin, digests) for each scheme: a linked set has at least `margin` of the digests, too."""
        mixed, high = _mix(x + U(0xABCDEF)), x >> U(32)
        for k, most, segments in self.schemes(len(x)):
            at = (high * U(segments)) >> U(32)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums, seen = np.add.reduceat(mixed, first), at[first]
            margin = max(len(seen) - most, 1)
            if len(seen) <= most:
                empty = np.setdiff1d(np.arange(segments, dtype=U), seen)
                seen, sums = np.concatenate([seen, empty]), np.concatenate([sums, np.zeros(len(empty), U)])
            yield k, margin, _mix(sums ^ _mix(seen * U(0x9E3779B97F4A7C15) + U(k + 1))) >> U(12)


class _Branch:
    __slots__ = ("any", "depth", "hi", "kids", "leaf", "lo", "part", "uniform")

    def __init__(self, part: np.ndarray, depth: int, n: int, own: int) -> None:
        self.part, self.depth, self.lo, self.hi = part, depth, n, n  # depth: n-grams of the path, part's included
        self.kids: dict[int, _Branch] = {}
        self.leaf, self.any, self.uniform = -1, own, True


class Trie:
    """Joins sets one after another and keeps their components."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.root, self.parent = _Branch(np.zeros(0, U), 0, 0, -1), []
        self.root.lo = 1 << 60
        self.visits = 0

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def add(self, x: np.ndarray) -> None:
        own = len(self.parent)
        self.parent.append(own)
        if own:
            self._walk(x, own)
        self._insert(x, own)

    def _walk(self, x: np.ndarray, own: int) -> None:
        num, den, n, find = self.num, self.den, len(x), self.find
        least, most = -(-num * n // den), n * den // num
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, used = stack.pop()
            if node.hi < least or node.lo > most:
                continue
            mine = find(own)
            if node.uniform:
                if node.any >= 0 and find(node.any) == mine:
                    continue
            elif node.leaf < 0 and all(k.uniform for k in node.kids.values()) and len({find(k.any) for k in node.kids.values()}) == 1:
                node.uniform = True
                if find(node.any) == mine:
                    continue
            need = -(-num * (n + max(node.lo, least)) // (num + den))
            before = node.depth - len(node.part)
            if overlap + min(node.hi - before, n - used) < need:
                continue
            self.visits += 1
            if len(node.part):
                at = np.searchsorted(x, node.part)
                at[at == n] = n - 1
                overlap += int(np.count_nonzero(x[at] == node.part))
                used = int(np.searchsorted(x, node.part[-1], "right"))
                if overlap + min(node.hi - node.depth, n - used) < need:
                    continue
            if node.leaf >= 0 and (num + den) * overlap >= num * (n + node.depth):
                a, b = find(node.leaf), mine
                self.parent[max(a, b)] = min(a, b)
            if node.kids:
                later, rest = [], x[used:]
                for first, kid in node.kids.items():
                    k = int(np.searchsorted(rest, U(first)))
                    (later if k < len(rest) and rest[k] == first else stack).append((kid, overlap, used))
                stack += later

    def _insert(self, x: np.ndarray, own: int) -> None:
        n, at, node, mine = len(x), 0, self.root, self.find(own)
        while True:
            if node.any < 0:
                node.any = own
            node.uniform = node.uniform and self.find(node.any) == mine
            node.lo, node.hi = min(node.lo, n), max(node.hi, n)
            if at == n:
                node.leaf = own  # sets are distinct
                return
            kid = node.kids.get(int(x[at]))
            if kid is None:
                node.kids[int(x[at])] = leaf = _Branch(x[at:], n, n, own)
                leaf.leaf = own
                return
            size = min(len(kid.part), n - at)
            differ = np.flatnonzero(kid.part[:size] != x[at : at + size])
            same = int(differ[0]) if len(differ) else size
            if same < len(kid.part):
                top = _Branch(kid.part[:same], kid.depth - len(kid.part) + same, kid.lo, kid.any)
                top.hi, top.uniform = kid.hi, kid.uniform
                kid.part = kid.part[same:]
                top.kids[int(kid.part[0])] = kid
                node.kids[int(x[at])] = kid = top
            node, at = kid, at + same


def _sets(n: int, num: int, den: int):
    """doc_id, text_hash, n_shingles, node of each document, and the schemes of each node once for each partition that has it."""
    names = ["doc_id", "text_hash", "n_shingles", "node", "schemes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for b in slices(batches):
            size, node, ends, rows = [], [], [0], []
            for t in b.column(2).to_pylist():
                x = shingles(t, n)
                size.append(len(x))
                node.append(node_of(x))
                if len(x) and node[-1] not in seen:
                    seen.add(node[-1])
                    rows += bands.signatures(x)
                ends.append(len(rows))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *(len(r[2]) for r in rows)], dtype=np.int32), np.concatenate([np.zeros(0, U), *(r[2] for r in rows)]).view(np.int64))
            schemes = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), lists], ["band", "margin", "signatures"])
            columns = [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), schemes)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _candidates(found: DataFrame) -> DataFrame:
    """Edges (a, b) of the candidate graph, written, from node, band, margin, signatures.

    Linked sets share at least `margin` digests of a band. Digests of at most FEW nodes are counted for each pair of
    these; with as many common digests as both of a pair have, it has to reach the margin. A common digest (often that of
    a segment with nothing but an n-gram of some passage in it) joins only nodes that have as many common ones as their margin:
    any other node shares a rare digest with each of its partners. Near copies by the thousand keep theirs.
    """
    rows = found.select("node", "band", "margin", F.explode("signatures").alias("signature"))
    # grouped by more than the digest: the joins then deal both sides themselves, and can split a digest that many nodes share
    more = F.col("signature").bitwiseAND(1).alias("h")
    parts = []
    for k in range(PASSES):
        some = rows.where(F.shiftright("signature", 1) % PASSES == k)
        again = some.groupBy("signature", more).agg(F.count("*").alias("n")).where("n > 1").drop("h")
        parts.append(durable(some.join(again, "signature"), "ngram-shared"))
    shared = reduce(DataFrame.unionByName, parts)
    common = shared.where(F.col("n") > FEW).select("node", "band", "margin", "signature")
    held = durable(common.groupBy("node", "band").agg(F.countDistinct("signature").alias("held")), "ngram-common")
    few = shared.where(F.col("n") <= FEW).join(held, ["node", "band"], "left").na.fill(0, ["held"])
    group = few.groupBy("signature", "band").agg(F.collect_set(F.struct("node", "margin", "held")).alias("g"))  # at most FEW
    pair = lambda x, y: F.struct(x["node"].alias("a"), y["node"].alias("b"), F.greatest(x["margin"], y["margin"]).alias("margin"), F.least(x["held"], y["held"]).alias("held"))
    pairs = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: y["node"] < x["node"]), lambda y: pair(x, y))))
    pairs = group.where(F.size("g") > 1).select("band", F.explode_outer(pairs).alias("p")).select("band", "p.*").where("a IS NOT NULL")
    pairs = pairs.groupBy("a", "b", "band").agg(F.count("*").alias("rare"), F.max("margin").alias("margin"), F.max("held").alias("held"))
    rare = pairs.where("rare + held >= margin").select("a", "b")
    kept = common.join(held, ["node", "band"]).where("held >= margin").select("node", "signature")
    least = kept.groupBy("signature", more).agg(F.min("node").alias("b")).drop("h")
    star = kept.join(least, "signature").where("node <> b").select(F.col("node").alias("a"), "b")
    edges = durable(rare.unionByName(star), "ngram-edges")
    discard(*parts, held)
    return edges


def _loaded(n: int):
    """node, n, set of the documents whose set is still the node that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [(node, shingles(text, n)) for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            rows = [(node, len(x), x.tobytes()) for node, x in sets if node_of(x) == node]
            cols = list(zip(*rows)) or [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["node", "n", "set"])

    return run


def _joined(num: int, den: int):
    """node, root for every set that has a partner; rows of one trie come one after another."""

    def links(nodes: list[int], trie: Trie):
        roots = [nodes[trie.find(k)] for k in range(len(nodes))]
        return [(a, r) for a, r in zip(nodes, roots) if a != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, trie, out = None, [], None, []

        def batch():
            cols = list(zip(*out)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

        for b in batches:
            for c, i, j, node, data in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3)), b.column(5)):
                if (c, i, j) != key:
                    if trie:
                        out += links(nodes, trie)
                    key, nodes, trie = (c, i, j), [], Trie(num, den)
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    trie.add(np.frombuffer(data.as_py(), U))
            if len(out) > 10_000:
                yield batch()
                out = []
        if trie:
            out += links(nodes, trie)
        yield batch()

    return run


def _grams(num: int, den: int):
    """node, n, band, gram for each n-gram of a set."""
    names = ["node", "n", "band", "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = Bands(num, den).low
        for b in slices(batches):
            for node, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                gram = np.frombuffer(data.as_py(), np.int64)
                same = [np.full(n, node, np.int64), np.full(n, n, np.int64), np.full(n, bisect_right(low, n) - 1, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*same, gram)], names=names)

    return run


def _by_rarity(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) from node, n, set: a graph whose components hold all links, without those that only a passage makes.

    Prefix filter: in one order of all n-grams, the rarest first, a set of n without its last ceil(s * n) - 1 n-grams is its head.
    Linked sets share an n-gram that is in the head of the smaller one at s = 2 * num / (num + den), and in that of the larger one
    at s = num / den. An n-gram that only one set has comes first and needs no row, as places are counted from the end.
    Heads meet by n-gram and size band of the smaller set.
    """
    grams = sets.select("node", "n", "set").mapInArrow(_grams(num, den), "node long, n long, band int, gram long")
    grams = durable(grams, "ngram-grams")
    # grouped by more than the n-gram: the join then deals both sides itself, and can split an n-gram that many sets share
    often = grams.groupBy("gram", F.xxhash64("gram").alias("h")).agg(F.count("*").alias("often")).where("often > 1").drop("h")
    last = Window.partitionBy("node").orderBy(F.desc("often"), "gram")
    head = grams.join(often, "gram").withColumn("k", F.row_number().over(last)).where(F.col("k") * den >= F.col("n") * num)
    small = F.col("k") * (num + den) >= F.col("n") * (2 * num)
    keys = F.array(F.struct("band", small.alias("small")), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("small")))
    keys = durable(head.select("node", "gram", F.explode(keys).alias("key")).select("node", "gram", "key.*"), "ngram-heads")
    met = keys.groupBy("gram", "band", F.xxhash64("gram").alias("h")).agg(F.min("node").alias("b"), F.max("node").alias("most"), F.max("small").alias("small"))
    met = met.where("small AND b < most").select("gram", "band", "b")
    edges = durable(keys.join(met, ["gram", "band"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "ngram-head-edges")
    discard(grams, keys)
    return edges


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b (the smallest node of its component) of all nodes but those, from all edges (a, b) of a graph.

    Each turn hooks roots to the smallest one beside them; within two turns a root is hooked or has others hooked to it, so the turns are few.
    """
    cols = [np.zeros((2, 0), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches)]
    nodes, ends = np.unique(np.concatenate(cols, axis=1), return_inverse=True)
    root, ends = np.arange(len(nodes)), ends.reshape(2, -1)
    while len((ends := root[ends][:, root[ends[0]] != root[ends[1]]])[0]):
        np.minimum.at(root, ends.max(axis=0), ends.min(axis=0))
        while ((up := root[root]) != root).any():
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of the nodes of `edges` (a, b; written) but for the roots: star contraction.

    A turn is one written query and one count, and nothing in it is broadcast, as the driver keeps something of each job and each broadcast
    until its garbage is collected; what earlier queries left there goes first. A turn has ten stages, whatever it moves, so a graph of at most
    EDGES edges, from the start or after some turns, goes to one task instead.
    """
    release(edges.sparkSession)
    left = edges.count()
    edges, made = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None
    while left > EDGES:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # grouped by more than the node: the joins then deal both sides themselves, and can split a node with very many edges
        least = both.groupBy("a", F.xxhash64("a").alias("h")).agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a", F.xxhash64("a").alias("h")).agg(F.min("b").alias("m")).drop("h")
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, made = made, durable(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        if last is not None:
            discard(last)
        edges = made
        # done when each node has one edge down and none of those has edges up: nothing moves any more
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
        ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        left, moves = ends.agg(F.sum("down"), F.count_if(F.expr("down + up > 1 AND down > 0"))).first()
        if not moves:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = durable(edges.coalesce(1).mapInArrow(_forest, "a long, b long"), "edges")
    if made is not None:
        discard(made)
    return found.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _blocked(nodes: DataFrame, block: int, seed: int) -> DataFrame:
    """`nodes` (node, c, n_shingles, ...) with b, of `blocks` blocks of a group c."""
    # grouped by more than the group: the join then deals both sides itself, and can split a large group
    total = nodes.groupBy("c", F.xxhash64("c").alias("h")).agg(F.ceil(F.sum("n_shingles") / block).alias("blocks")).drop("h")
    return nodes.join(total, "c").withColumn("b", F.pmod(F.xxhash64("node", F.lit(seed)), "blocks"))


def _member(i, j):
    return F.struct(F.col("c"), i.alias("i"), j.alias("j"))


class _Linker:
    """Finds the links in tries of nodes; the sets of all nodes that go to tries are made from the texts once."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, candidates: DataFrame, n: int, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        groups = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
        wanted = durable(groups.join(nodes, "node").select("node", F.col("root").alias("c"), "n_shingles", "place"), "ngram-wanted")
        self.grouped = wanted.drop("place")
        # the nodes grow with the documents, so they are never broadcast, however small a table is
        wanted = wanted.select("node", "place.*").hint("merge").alias("w")
        own = texts.alias("t").join(wanted, [F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("t.text_hash") == F.col("w.text_hash")])
        self.sets = durable(own.select("node", "text").mapInArrow(_loaded(n), "node long, n long, set binary"), "ngram-wanted-sets")

    def regrouped(self, large: DataFrame) -> DataFrame:
        """node, c, n_shingles: smaller groups for those of `large` (node, c, n_shingles), without nodes that no other can be linked with."""
        found = components(_by_rarity(self.sets.join(large.select("node"), "node"), self.num, self.den))
        found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        return large.drop("c").join(found, "node").select("node", F.col("root").alias("c"), "n_shingles")

    def links(self, tries: DataFrame) -> DataFrame:
        """Edges (a, b) from node, members: the tries (c, i, j) that a node goes to."""
        loaded = self.sets.join(tries, "node").select(F.explode("members").alias("m"), "node", "n", "set").select("m.*", "node", "n", "set")
        loaded = loaded.repartition(self.parts, "c", "i", "j").sortWithinPartitions("c", "i", "j", "n", "node")
        return durable(loaded.mapInArrow(_joined(self.num, self.den), "a long, b long"), "ngram-links")


def _all_links(linker: _Linker, block: int) -> DataFrame:
    """Edges (a, b) that have the components of all links.

    A group of one block has one trie. Larger ones are grouped anew by their rare n-grams. Of one that is still larger each block has a trie; then a few members of each component that is
    known so far are dealt to blocks anew, in turns, as long as that joins a good part of them. What is in the largest component
    by then needs no comparison within it: only the nodes outside it meet all others, block by block.
    """
    grouped = durable(_blocked(linker.grouped, block, 0), "ngram-groups")
    large = grouped.where("blocks > 1").select("node", "c", "n_shingles")
    if not large.isEmpty():
        grouped = grouped.where("blocks = 1").unionByName(_blocked(linker.regrouped(large), block, 0).select(*grouped.columns))
        grouped = durable(grouped, "ngram-groups")
    one = lambda blocked: blocked.select("node", F.array(_member(F.col("b"), F.col("b"))).alias("members"))
    found = linker.links(one(grouped))
    large = grouped.where("blocks > 1").select("node", "c", "n_shingles")
    if large.isEmpty():
        return found
    state, turn = None, 0
    while True:
        known = components(found)
        found = known.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = large.join(known, "node", "left").select(*large.columns, F.coalesce("root", "node").alias("root"))
        roots = durable(roots, "ngram-roots")
        last, state = state, roots.select(F.countDistinct("c", "root")).first()[0]
        if last is not None and state > 0.8 * last:
            break
        turn += 1
        order = Window.partitionBy("c", "root").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        few = roots.withColumn("k", F.row_number().over(order)).where(F.col("k") <= MEMBERS)
        found = found.unionByName(linker.links(one(_blocked(few.select(*large.columns), block, turn))))
    by = roots.groupBy("c", "root").agg(F.sum("n_shingles").alias("n")).groupBy("c").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    outside = roots.join(by, "c").where("root <> largest").select(*large.columns)
    outside = durable(_blocked(outside, block, 1), "ngram-outside")
    p = outside.select("c", F.col("blocks").alias("p")).distinct()
    every = _blocked(roots.join(p.select("c"), "c", "left_semi").select(*large.columns), block, 0)
    q = every.select("c", F.col("blocks").alias("q")).distinct()
    counted = lambda n, make: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), make)
    left = outside.join(q, "c").select("node", counted("q", lambda j: _member(F.col("b"), j)).alias("members"))
    right = every.join(p, "c").select("node", counted("p", lambda i: _member(i, F.col("b"))).alias("members"))
    both = left.unionByName(right).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"))
    return found.unionByName(linker.links(both))


def classes(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for each row of `docs` (doc_id, text, ...).

    Two documents link when den * intersection >= num * union of their sets of n-grams.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, n_shingles long, node long, schemes array<struct<band:int,margin:int,signatures:array<long>>>"
    sets = durable(texts.mapInArrow(_sets(n, num, den), schema), "ngram-sets")
    edges = _candidates(sets.select("node", F.inline("schemes")))
    rows = durable(sets.drop("schemes"), "ngram-rows")
    discard(sets)
    candidates = components(edges)
    discard(edges)
    place = F.min(F.struct("doc_id", "text_hash"))  # any one of its documents
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), place.alias("place"), F.min("doc_id").alias("low"))
    nodes = durable(nodes, "ngram-nodes")
    linker = _Linker(texts, nodes, candidates, n, num, den)
    links = components(_all_links(linker, block))
    discard(linker.sets)
    roots = nodes.join(links, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    # grouped by more than the root: the join then deals both sides itself, and can split a large component
    least = roots.groupBy("root", F.xxhash64("root").alias("h")).agg(F.min("low").alias("component_id")).drop("h")
    by_node = roots.join(least, "root").select("node", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(by_node, "node").select("doc_id", "text_hash", "n_shingles", "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row of the smallest doc_id, and one of those with an empty set.

    Of rows that repeat doc_id and text, one stays.
    """
    found = classes(docs, n, num, den)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    some = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(order).alias("stays")).select("stays.doc_id", "stays.text_hash")
    none = found.where("n_shingles = 0").agg(F.min(order).alias("stays")).where("stays IS NOT NULL").select("stays.doc_id", "stays.text_hash")
    stays = some.unionByName(none)
    copies = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    same = lambda a, b: [F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")), F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash")]
    stays = stays.alias("s").join(copies.alias("c"), same("s", "c")).select("s.*", "copies").alias("s")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash")).alias("r")
    kept = rows.join(stays, same("r", "s")).select("r.*", "copies")
    single = kept.where("copies = 1").select("row.*")
    several = kept.where("copies > 1").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(several)
